"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens lie end to end in one ragged array of symbol ids. Each round looks up the rank of
every adjacent pair, takes each sequence's lowest one by a segmented minimum and merges all its occurrences, in all
sequences at once. Sequences without a known pair leave the array; the symbols that they have left are their count.

A pair made in a round holds the round's new symbol, so its rank is higher than the round's: merging all occurrences of
a sequence's lowest pair together, from the left and without overlaps, equals merging them one at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import Memo, fresh, kept, text_slices, texts_of

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct pre-tokens in each generation of what a worker remembers.
MEMO = 400_000
NO_RANK = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1, else the next of those from 256 on."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    hidden = np.cumsum([not v for v in visible])
    return [chr(b) if visible[b] else chr(255 + int(hidden[b])) for b in range(256)]


class MergeTable:
    """A byte-level BPE vocabulary as arrays: sorted pair keys with the rank and the merged symbol of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.symbols = len(ids)
        self.byte_ids = np.array([ids[c] for c in byte_alphabet()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.symbols + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.memo = Memo(MEMO)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each word (of one byte at least)."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), out)
        while len(symbols) > 1:
            key = symbols[:-1] * self.symbols + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lens = np.diff(np.append(first, len(owner)))
            lowest = np.minimum.reduceat(rank, first)
            out[owner[first]] = lens
            hit = (rank == np.repeat(lowest, lens)) & (rank != NO_RANK)
            # hits in a row are one symbol repeated: of those, each second one overlaps the one before
            i = np.arange(len(hit))
            run = i - np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), i, 0))
            hit &= run % 2 == 0
            symbols = symbols.copy()
            symbols[hit] = self.merged[at[hit[:-1]]]
            keep = ~np.append(False, hit[:-1]) & np.repeat(lowest != NO_RANK, lens)
            symbols, owner = symbols[keep], owner[keep]
        out[owner] = len(owner) and 1  # at most one symbol of one word is left here
        return out

    def text_counts(self, texts: list[str]) -> list[int]:
        """The tokens of each text; a special string inside a text is one token."""
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append([w for part in parts for w in self.pattern.findall(part)])
        new = self.memo.missing(set().union(*split))
        if new:
            self.memo.now.update(zip(new, self.count([w.encode() for w in new]).tolist(), strict=True))
        of = self.memo.now.__getitem__
        return [n + sum(map(of, words)) for n, words in zip(extra, split, strict=True)]


@kept
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, limit: int = 1024) -> DataFrame:
    """One row per row of ``df``: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Narrow: no shuffle, one slice of texts in memory. A null text counts as empty (0 tokens), a null id stays null,
    repeated rows are counted each, an empty table gives no rows; other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(merge_table)
        bpe = merge_table(vocabulary)
        for batch in text_slices(batches, 1):
            texts = texts_of(batch.column(1))
            n = bpe.text_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
