"""Sets of word n-grams ("shingles") as arrays of 64-bit hashes, worked out in blocks of bounded size.

A word's hash mixes it eight bytes at a time, words over sixteen bytes go through BLAKE2b. A shingle's hash mixes a weighted sum of its words' hashes.
Two different shingles of a pair of documents share a hash with a probability of about their product of set sizes over 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text whose words are hashed at once; blocks end at white space, so only a longer word makes a longer block.
BLOCK = 1 << 18

U = np.uint64
#: Odd numbers: the weights of a shingle's words.
WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], U)
ODD = 0x9E3779B97F4A7C15
#: A to Z in lower case, and all white space as one kind.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
SHORT = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def block_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and first byte's place of each word of a folded block."""
    padded = np.frombuffer(b" ".join([b"", block, bytes(SHORT)]), np.uint8)
    inside = padded[: len(block) + 2] != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.empty(0, U), start
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mixed((lanes[start] & FIRST[np.minimum(length, 8)]) + length.astype(U) * U(ODD))
        second = np.flatnonzero(length > 8)
        if len(second):
            rest = lanes[start[second] + 8] & FIRST[np.minimum(length[second] - 8, 8)]
            out[second] = mixed(out[second] ^ mixed(rest + U(ODD)))
    for i in np.flatnonzero(length > SHORT).tolist():
        word = block[start[i] - 1 : start[i] - 1 + length[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, start - 1


def blocks(text: bytes, most: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Pieces of a folded text and where they begin; each ends at white space or with the text."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= most else text.rfind(b" ", at, at + most) + 1
        if not end:
            end = text.find(b" ", at + most) + 1 or len(text)
        yield at, text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and where each text's words end."""
    joined = b" ".join([*texts, b""]).translate(FOLD)
    found = [(h, at + start) for at, block in blocks(joined) for h, start in [block_hashes(block)]]
    if not found:
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    hashes, start = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending. Fewer words than ``words``: one shingle of them all; none: none."""
    word, ends = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        weights = WEIGHTS[:words] if words <= len(WEIGHTS) else mixed(np.arange(1, words + 1).astype(U)) | U(1)
        rolled = np.zeros(max(len(word) - words + 1, 0), U)
        for k in range(words):
            rolled += word[k : k + len(rolled)] * weights[k]
        rolled = mixed(rolled)
        first = 0
        for last in ends.tolist():
            n = last - first
            if n >= words:
                tokens = np.sort(rolled[first : last - words + 1])
                out.append(tokens[np.append(True, tokens[1:] != tokens[:-1])])
            elif n:
                out.append(mixed((word[first:last] * weights[:n]).sum(dtype=U) + U(n) * U(ODD)).reshape(1))
            else:
                out.append(np.empty(0, U))
            first = last
    return out


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mixed(tokens + U(1)).sum(dtype=U)
        b = np.bitwise_xor.reduce(mixed(tokens ^ U(ODD)), initial=U(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))
