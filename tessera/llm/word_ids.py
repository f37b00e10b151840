"""Ids of the word-level BPE vocabulary as the tokenizers library gives them, an end id after each document.

No token crosses a space or a line feed and normalisation keeps both as white space, so the library's ids of a text are those of the
chunks between them, one after the other. A slice's distinct chunks are found by Arrow, each is looked up once, and the ids are put
together by arrays. A worker remembers chunks that it has seen. New chunks of Latin letters, digits and punctuation are split into
words as the library splits them, and their distinct words are merged by the vocabulary's own merges, all at once. All other
chunks go to the library whole.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
from collections.abc import Iterator
from itertools import compress, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from tessera.llm.common import Memo, kept
from tessera.llm.word_merges import WordMerges

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Chunks in each generation of what a worker remembers.
MEMO = 500_000
#: How the vocabulary's file splits a chunk.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Chunks of these have no combining marks, and no capital whose lower case has one.
PLAIN = r"[!-~\u00A1-\u012F]"
#: Code points from here on are not PLAIN.
BEYOND = 0x130
#: What a code point of PLAIN is to WORDS; a line feed is the break between chunks.
BREAK, LETTER, NUMBER, OTHER, NOT_PLAIN = range(5)
KINDS = np.array([BREAK if c == "\n" else NOT_PLAIN if not regex.fullmatch(PLAIN, c) else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER for c in map(chr, range(BEYOND + 1))], np.uint8)
LOWER = np.array([ord(chr(c).lower()[:1]) for c in range(BEYOND + 1)], "<u4")
#: The letters of WORDS' contractions, as code points.
AFTER_APOSTROPHE_1, AFTER_APOSTROPHE_2 = [ord(c) for c in "stmd"], [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]
#: What special strings begin with.
SPECIAL = b"<|"
#: First bytes of U+0300 to U+037F, where all marks are that A to Z compose with.
MARKS = (b"\xcc", b"\xcd")
LOWER_A_TO_Z = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """Many small objects, no cycles among them: looking for such takes a tenth of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def runs_of(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool holds runs of these sizes. Those that the codes name, one after the other, and where each ends."""
    starts, size = (np.cumsum(size) - size)[codes], size[codes]
    ends = np.cumsum(size)
    at = np.repeat(starts - ends + size, size)
    at += np.arange(len(at))
    return pool[at], ends


def distinct_of(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings among those that the offsets cut from the data (bytes and offsets), and which of them each is."""
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    _, cuts, held = found.dictionary.buffers()
    cuts = np.frombuffer(cuts, np.int64)[: len(found.dictionary) + 1]
    return np.frombuffer(held or b"", np.uint8)[: cuts[-1]], cuts, found.indices.to_numpy()


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if any(x.lstrip or x.rstrip or " " in x.content or "\n" in x.content for x in self.library.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: special tokens of this vocabulary take up white space")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x.get("pattern", {}).get("Regex") for x in spec["pre_tokenizer"]["pretokenizers"]]
        self.by_words = kinds[0] == ["NFC", "Replace", "Lowercase"] and str(kinds[1][0]).replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == WORDS
        self.merges = WordMerges(spec) if self.by_words else None
        self.memo = Memo(MEMO)

    def one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    @staticmethod
    def plain_chunks(new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' code points and their kinds, with a line feed after each chunk, and which of the chunks are plain; the others' code points are left out."""
        points = np.frombuffer(b"\n".join([*new, b""]).decode().encode("utf-32-le"), "<u4")
        kind = KINDS[np.minimum(points, BEYOND)]
        breaks = np.flatnonzero(points == 10)
        bad = kind == NOT_PLAIN
        bad[:-1] |= (points[:-1] == SPECIAL[0]) & (points[1:] == SPECIAL[1])
        plain = ~np.logical_or.reduceat(bad, np.append(0, breaks[:-1] + 1))
        if not plain.all():
            stays = np.repeat(plain, np.diff(breaks, prepend=-1))
            points, kind = points[stays], kind[stays]
        return LOWER[points], kind, plain

    @staticmethod
    def word_begins(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a word as WORDS cuts them, or a break, begins at each code point of plain chunks in lower case."""
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero(begins & (points == ord("'")))
        if len(at):
            one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
            for letters, hit in ((1, np.isin(one, AFTER_APOSTROPHE_1)), (2, np.isin(one << 16 | two, AFTER_APOSTROPHE_2))):
                begins[at[hit] + 1] = False
                begins[at[hit] + 1 + letters] = True
        return begins

    def plain_ids(self, points: np.ndarray, kind: np.ndarray) -> list[bytes]:
        """The ids of each plain chunk: the distinct words of all of them are merged at once."""
        begins = np.flatnonzero(self.word_begins(points, kind))
        is_word = kind[begins] != BREAK
        if not is_word.any():
            return [b""] * int(np.count_nonzero(points == 10))
        length = np.add.reduceat(1 + (points >= 128), begins)[is_word]  # in UTF-8; such a code point has two bytes at most
        data, cuts, codes = distinct_of(points[kind != BREAK].tobytes().decode("utf-32-le").encode(), np.append(0, np.cumsum(length)))
        flat, ends = runs_of(*self.merges.merge(data, np.diff(cuts)), codes)
        before = np.searchsorted(begins[is_word], np.flatnonzero(points == 10))  # words before each chunk's end
        data, cuts = flat.tobytes(), (4 * np.append(0, ends)[before]).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def learn(self, new: list[bytes]) -> None:
        """Puts the chunks' ids into the memo."""
        if self.by_words:
            points, kind, plain = self.plain_chunks(new)
            if len(points):
                self.memo.now.update(zip(compress(new, plain), self.plain_ids(points, kind), strict=True))
            new = [*compress(new, ~plain)]
        if new:
            self.memo.now.update(zip(new, self.one_by_one([c.decode() for c in new]), strict=True))

    @staticmethod
    def may_lower(text: bytes) -> bool:
        """Whether A to Z may be lower-cased up front, as normalisation does later: not if the text may hold a special string or a mark that a capital composes with first."""
        return SPECIAL not in text and (text.isascii() or not any(lead in text for lead in MARKS))

    def encode_flat(self, texts: list[bytes], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, as little-endian unsigned 32-bit integers, with the end id after each; and where each text's ids end."""
        if not texts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        lines = [t.translate(LOWER_A_TO_Z) if self.may_lower(t) else t.replace(b"\n", b" ") for t in texts]
        joined = b" ".join([*lines, b""])  # a space after each chunk
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        last = np.searchsorted(spaces, np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1)
        data, cuts, codes = distinct_of(joined.replace(b" ", b""), np.append(0, spaces - np.arange(len(spaces))))
        del lines, joined, spaces
        data, cuts = data.tobytes(), cuts.tolist()
        chunks = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        del data, cuts
        self.memo.turn()
        new = self.memo.missing(set(filterfalse(self.memo.now.__contains__, chunks)), turn=False)
        if new:
            with no_collection():
                self.learn(new)
        ids = [*map(self.memo.now.__getitem__, chunks), b"" if end_id is None else np.array([end_id], "<u4").tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, ends = runs_of(np.frombuffer(b"".join(ids), "<u4"), size, np.insert(codes, last + 1, len(chunks)))
        return flat, ends[last + 1 + np.arange(len(texts))]

    def encode(self, texts: list[bytes], end_id: int | None = END_ID) -> list[np.ndarray]:
        """The ids of each text (UTF-8) as little-endian unsigned 32-bit integers, with the end id."""
        flat, ends = self.encode_flat(texts, end_id)
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


@kept
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
