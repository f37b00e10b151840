"""Language ID by rank-order profiles.

A profile is a language's most frequent n-grams (of one to three letters, word borders included) in order. A document's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum of how far each one's rank lies from its rank there, with the
profile's length for one that isn't there. The nearest profile is the prediction.
"""

from __future__ import annotations

import functools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, text_slices, texts_of

#: N-grams in a profile.
PROFILE = 400
UNKNOWN = "und"
#: Full profiles (PROFILE rows each) that the driver holds and sends out at most; more are an error, none is left out.
LANGUAGES = 1000
#: Distinct (language, n-gram) counts that a task gathers before it hands them on.
GATHERED = 1 << 20
BITS = 21  # a code point; three of them are an n-gram in 63 bits
BORDER = 1  # not 0, so that n-grams of different lengths differ


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams and their counts; words are runs of letters in lower case, with a border on either side."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    points = np.where(letters()[points], points, BORDER) if len(points) else points
    points = np.concatenate([[BORDER], points, [BORDER]])
    points = points[np.append(True, (points[1:] != BORDER) | (points[:-1] != BORDER))]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = points[:-1] << BITS | points[1:]
    three = two[:-1] << BITS | points[2:]
    found = np.concatenate([points[points != BORDER], two, three[points[1:-1] != BORDER]])  # none goes across a border
    return np.unique(found, return_counts=True)


def top(found: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, in order; of equals the smaller code first (found is sorted)."""
    return found[np.argsort(-counts, kind="stable")[:n]]


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages of ``df``, from all its rows with text and language.

    Tasks count n-grams per language over whole texts and hand on one row per language and n-gram; those are summed per key, ranked in each language,
    and only the profiles come to the driver: LANGUAGES times ``profile`` rows at most. If there are more, which takes over LANGUAGES languages, it's an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            return codes, np.bincount(place, np.concatenate([b for _, b in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in text_slices(batches, 0, 2 << 20):
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            if sum(len(parts[0][0]) for parts in held.values()) > GATHERED:
                yield from out()
        yield from out()

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    ranked = sums.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram", "rank").orderBy("lang", "rank").select("lang", "gram")
    found = ranked.limit(LANGUAGES * profile + 1).collect()
    if len(found) > LANGUAGES * profile:
        raise ValueError(f"profiles of over {LANGUAGES} languages: more than {LANGUAGES * profile} rows for the driver")
    for lang, gram in found:
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.names, self.length = sorted(profiles), length
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1)
        for row, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64)
            self.ranks[row, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, the first by name of equals; the score is how much nearer it is than the farthest possible."""
        own = top(*grams(text), self.length)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[:, at]
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.length).sum(1)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (self.length * len(own))


def identify(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE, columns: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: its id (or ``columns``, whose last is the text), lang_pred and score.

    Narrow: no shuffle, whole texts, one slice of them in memory. ``und`` with score 0 if the text is null or has no letter, or if there are no profiles;
    a null id stays null, repeated rows are predicted each, an empty table gives no rows; other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        model = Profiles(sent.value, length)
        for batch in text_slices(batches, batches_text, 4 << 20):
            found = [model.predict(t) for t in texts_of(batch.column(batches_text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batches_text + keep_text)), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, "lang_pred", "score"])

    sent = df.sparkSession.sparkContext.broadcast(profiles)
    keep_text = columns is not None
    names = columns or [id_col]
    batches_text = len(names) - keep_text
    picked = df.select(*names) if columns else df.select(id_col, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def with_letter(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, whose last is the text, of the rows whose text has a letter: those that ``identify`` names a language for if there are profiles. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(columns) - 1, 4 << 20):
            yield batch.filter(pa.array([any(map(str.isalpha, t)) for t in texts_of(batch.column(len(columns) - 1))], pa.bool_()))

    picked = df.select(*columns)
    return picked.mapInArrow(run, picked.schema)


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2


def predictions(df: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    profiles = fit(df.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(df, profiles).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
