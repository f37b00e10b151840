"""Exact dedup: groups by 128-bit content hash, bytes compared inside groups.

Texts are grouped by hash and bytes together, so the aggregation itself compares bytes wherever hashes are equal, and copies in one
input partition collapse before the shuffle. Only one narrow row per distinct text with copies goes back to the rows; that join is on
the hash, a second digest that parts texts which share the hash, and a salt that deals large groups of copies out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a group of copies are dealt to when they look up the row that stays.
SALTS = 32


def normalised(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: its id, keep_id, group_size, kept and text_sha256.

    Of rows with equal bytes the one with the smallest (or ``keep="largest"``) id stays. A null text counts as empty; null ids never stay while the
    group has others (a group of null ids alone keeps null); of repeated rows with the id that stays all are kept; an empty table gives
    no rows; other columns of ``df`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    pick = F.min if keep == "smallest" else F.max
    docs = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    keyed = docs.select("id", "text", F.unhex(F.md5("text")).alias("hash"))
    texts = keyed.groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copied = texts.where("group_size > 1").select("hash", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = keyed.select("id", "hash", F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    out = rows.join(copied, ["hash", "digest", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, one per text: repeated rows of the id that stays collapse as well, to any one of them.

    Null and empty texts are equal; null ids stay only if the text has no other row. Whole texts are compared, however long. All columns keep their names and
    values, also those called as the working ones; an empty table gives no rows.
    """
    pick = F.min_by if keep == "smallest" else F.max_by
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    own = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    i, t = names[id_col], names[text_col]
    # null ids last: they stay only if the text has no other row
    order = F.struct(F.col(i).isNull(), i) if keep == "smallest" else F.struct(F.col(i).isNotNull(), i)
    row = F.struct(*(n for n in names.values() if n != t), F.col(t).isNull().alias("no_text"))
    groups = own.groupBy(F.unhex(F.md5(normalised(t))).alias("hash"), normalised(t).alias("bytes")).agg(pick(row, order).alias("row"))
    text = F.when(~F.col("row.no_text"), F.col("bytes").cast("string"))
    return groups.select(*((text if n == t else F.col(f"row.{n}")).alias(c) for c, n in names.items()))


ORACLE = """
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
