"""SentencePiece encoding and decoding with a merge-type prefix table.

For every prefix of a text there is exactly one token that can end its encoding. An automaton lists the pieces that end at
a position; of those, the one that is compatible with the last token of the prefix before it is entered. Two tokens are
compatible if merging their joined characters gives just these two back. The ids follow from the table backwards, from
the whole text's last token to the last token of what is left of it.

Where no piece holds two characters side by side, no merge joins them: there a text falls into parts that are encoded one by one.
Spaces after other characters are such places (in the vocabularies that are read here), so words are remembered, and their parts too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, fresh, kept, text_slices, texts_of

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Words, and parts, in each generation of what a worker remembers.
MEMO = 300_000
#: Pairs of tokens whose compatibility a worker remembers; beyond that it forgets all and goes on.
PAIRS = 1 << 20
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        self.pieces, self.kinds, scores = [], [], []
        for number, value in message:
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
        trainer = dict(fields(b"".join(v for n, v in message if n == 2)))
        normal = dict(fields(b"".join(v for n, v in message if n == 3)))
        if trainer.get(3) != 2 or normal.get(1) != b"identity" or normal.get(4, 1) or not normal.get(5, 1) or not trainer.get(35) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError(f"{path}: only BPE models with byte fallback, identity normalisation and plain pieces are read")
        if not normal.get(3, 1):
            raise ValueError(f"{path}: vocabularies without a leading space are not read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError(f"{path}: a piece holds a space after another character")
        self.inside = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [p]:  # others can't come out of merging
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.halves()
        self.memo, self.parts = Memo(MEMO), Memo(MEMO)
        self.out = [self.piece_bytes(i) for i in range(len(self.pieces))]

    def piece_bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, self.pieces[i].replace(SPACE, " ").encode())

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Plain merging: again and again the pair whose piece has the best score, the leftmost of equals, until ``stop`` are left."""
        parts = list(text)
        while True:
            if len(parts) <= stop:
                return parts
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self) -> None:
        """For each piece that merging makes: its place in the order of merges, and the two pieces of its last merge."""
        order = {p: n for n, p in enumerate(sorted(self.ids, key=lambda p: -self.scores[p]))}
        self.place = [order[p] if p in order and len(p) > 1 else -1 for p in self.pieces]
        self.left, self.right = list(range(len(self.pieces))), list(range(len(self.pieces)))
        for p, i in self.ids.items():
            if len(p) > 1:
                a, b = self.merge(p, 2) if len(p) > 2 else list(p)
                self.left[i], self.right[i] = self.ids.get(a, i), self.ids.get(b, i)
        self.in_order = [True] * len(self.pieces)
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                self.in_order[i] = all(self.in_order[h] and self.place[h] < self.place[i] for h in (self.left[i], self.right[i]))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both tokens never joins two across the border between them.

        The merges of either token are taken back, the latest first (of equals the right one's: merges go from the left). Before each of
        them, the two tokens that then meet at the border must not be ones that would have been merged first. Tokens from len(pieces) on are
        characters without a piece, which no merge takes. A few pieces (of spaces) come before their halves in the order of merges; pairs with
        them are merged to see.
        """
        pieces, place, n = self.pieces, self.place, len(self.pieces)
        if a >= n or b >= n:
            return True
        if not (self.in_order[a] and self.in_order[b]):
            return self.merge(pieces[a] + pieces[b]) == [pieces[a], pieces[b]]
        limit = n + 1
        while True:
            joined = self.ids.get(pieces[a] + pieces[b])
            if joined is not None and place[joined] < limit:
                return False
            if place[a] < 0 and place[b] < 0:
                return True
            if place[a] > place[b]:
                limit, a = place[a], self.right[a]
            else:
                limit, b = place[b] + 1, self.left[b]

    def encode_part(self, part: str) -> tuple[int, ...]:
        ids, pairs, strange = self.ids, self.pairs, len(self.pieces)
        if len(pairs) > PAIRS:
            pairs.clear()
        # the last token of each prefix: 0, which no text has, until it is found
        last = [0] + [0 if c in ids else strange + ord(c) for c in part]
        size = [0] + [0 if c in ids else 1 for c in part]
        for end, (n, piece) in self.automaton.iter(part):
            if last[end + 1]:
                continue
            if end + 1 > n:
                before = last[end + 1 - n]
                fits = pairs.get(key := before << 22 | piece)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, piece)
                if not fits:
                    continue
            last[end + 1], size[end + 1] = piece, n
        tokens, at = [], len(part)
        while at:
            if not last[at]:
                raise AssertionError(f"no token ends the prefix of {at} characters")
            tokens.append(last[at])
            at -= size[at]
        out: list[int] = []
        for token in reversed(tokens):
            out.extend([token] if token < strange else [self.byte_ids[b] for b in chr(token - strange).encode()])
        return tuple(out)

    def learn(self, words: set[str]) -> None:
        """Puts the words (without their space where they have just one) into ``memo``."""
        new = self.memo.missing(words)
        if not new:
            return
        split = []
        for word in new:
            word = word if word.startswith(SPACE) else SPACE + word
            cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.inside]
            split.append([word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word])
        for part in self.parts.missing(set().union(*split)):
            self.parts.now[part] = self.encode_part(part)
        of = self.parts.now.__getitem__
        self.memo.now.update((word, tuple(chain.from_iterable(map(of, parts)))) for word, parts in zip(new, split, strict=True))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        split = []
        for text in texts:
            words = text.split(" ") if SPACE not in text else [""]
            if "" in words:  # spaces side by side or at an end
                words = self.words(SPACE + text.replace(" ", SPACE)) if text else []
            split.append(words)
        self.learn(set().union(*split))
        of = self.memo.now.__getitem__
        return [list(chain.from_iterable(map(of, words))) for words in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@kept
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """One row per row of ``df``: its id, the piece ids of its text (array<int>) and their decoded text.

    Narrow: no shuffle, one slice of texts in memory. A null or empty text has no ids and decodes to the empty text, a null id
    stays null, repeated rows are encoded each, an empty table gives no rows; other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(piece_model)
        m = piece_model(model)
        for batch in text_slices(batches, 1, 2 << 20):
            ids = m.encode_all(texts_of(batch.column(1)))
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(list(map(m.decode, ids)), pa.string())], ["id", "ids", "decoded"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
