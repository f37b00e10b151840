"""N-gram Jaccard self-join with rare-first prefix filtering, and the components of its links.

1. Every document becomes its set of shingle hashes. Equal sets are one class; one row of each class is kept, in blocks of bounded size.
2. Shingles are counted over classes. A block sends each distinct shingle once, as 32 bits to one of as many parts as the corpus needs, and gets back
   the counts above one. So the order "rare ones first" is as fine for a large corpus as for a small one, and a shingle
   that a third of all documents hold is sent once per block.
3. Two sets that are similar enough share a shingle in the first part (the prefix) of that order. A shingle of one class alone can't be shared, so a class
   whose whole prefix is such shingles is done; of the others only the shared part of the prefix is posted by shingle.
4. Of each posting list every member is paired with one pivot of the list: the member with the smallest share of shingles of its own, as the text that others
   were copied from has. Pairs pass the length and positional filters; a class proposes the PROPOSALS pivots that it shares most shingles with. Each pair is verified once, behind the suffix filter.
   That links most of a large group of near copies with as many pairs as the group has members.
5. All other pairs whose members are then in different components are joined on their prefix shingles, list by list, with the same filters,
   and those not verified before are verified. A pair within one component can't change the components, so they are exact.

The positional filter takes a shared shingle for the first one that a pair shares: that is right for one of its rows, and a pair needs only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import Scratch, bytes_of, fresh, text_slices
from tessera.llm.graph import components
from tessera.llm.shingles import WORDS, U, mixed, set_keys, shingle_sets

#: The least similarity, as numerator and denominator.
LEAST = (75, 100)
#: Bytes of text in a block, and in what a Python worker makes into sets at once.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
#: Shingles that a part counts, about.
PART_SHINGLES = 1 << 21
#: Members that a part of a posting list has, about.
PART = 512
#: Pivots that a class is verified with before the join of components.
PROPOSALS = 3
#: Parts that the rows of a class are dealt to when they look up their component.
SALTS = 32

CODES = "block long, part int, tokens binary, codes binary"


def needed(nx, ny, least: tuple[int, int] = LEAST):
    """The smallest intersection of sets of these sizes that makes them similar enough: ceil(t / (1 + t) * (nx + ny))."""
    a, b = least
    return (a * (nx + ny) + a + b - 1) // (a + b)


def prefix_length(n, least: tuple[int, int] = LEAST):
    a, b = least
    return n - -(-a * n // b) + 1


def needed_sql(nx: str, ny: str, least: tuple[int, int] = LEAST) -> str:
    a, b = least
    return f"(({a} * ({nx} + {ny}) + {a + b - 1}) div {a + b})"


def filters(x: str, y: str, least: tuple[int, int] = LEAST) -> Column:
    """The length filter, and the positional filter of a first shared shingle, for structs or tables with n and pos."""
    a, b = least
    length = f"least({x}.n, {y}.n) * {b} >= greatest({x}.n, {y}.n) * {a}"
    place = f"1 + least({x}.n - {x}.pos, {y}.n - {y}.pos) - 1 >= {needed_sql(f'{x}.n', f'{y}.n', least)}"
    return F.expr(f"{length} and {place}")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection: sorted arrays are cut at the middle of one, where both sides' overlaps are bounded by the shorter part."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    if len(x) < len(y):
        x, y = y, x
    middle = len(y) // 2
    a = int(np.searchsorted(x, y[middle]))
    same = int(a < len(x) and x[a] == y[middle])
    return suffix_bound(x[:a], y[:middle], depth - 1) + same + suffix_bound(x[a + same :], y[middle + 1 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sets, ascending, are similar enough."""
    least_common = needed(len(x), len(y), least)
    if not len(x) or not len(y) or suffix_bound(x, y) < least_common:
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= least_common


def keyed(df: DataFrame, text_col: str, columns: list[str], words: int) -> DataFrame:
    """The columns, and n, k1 and k2 (128 bits) of each text's set."""
    at = df.select(text_col, *columns)
    schema = StructType(at.select(*columns).schema.fields[:]).add("n", "integer").add("k1", "long").add("k2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in text_slices(batches, 0, SLICE_BYTES):
            sets = shingle_sets(bytes_of(batch.column(0)), words)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(map(len, sets)), pa.int32()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())], schema.names)

    return at.mapInArrow(run, schema)


def blocked(classes: DataFrame, text_col: str) -> DataFrame:
    """Adds cid, a number of its own for each row, and block: rows that follow each other in a task with BLOCK_BYTES of text, or one row with more."""
    schema = StructType(classes.schema.fields[:]).add("cid", "long").add("block", "long")
    at = classes.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row, block, held = TaskContext.get().partitionId() << 33, 0, 0, 0
        for batch in text_slices(batches, at, SLICE_BYTES):
            size = batch.column(at).nbytes
            if held and held + size > BLOCK_BYTES:
                block, held = block + 1, 0
            held += size
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + n) + first), pa.array(np.full(n, first + block, np.int64))], schema.names)
            row += n

    return classes.mapInArrow(run, schema)


def class_rows(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per set that has shingles: the class's row with the smallest id (nulls last, ties by content), rows, n, k1, k2, cid and block."""
    has_word = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    columns = df.columns
    rows = keyed(df.where(has_word), text_col, columns, words)
    order = F.struct(F.col(id_col).isNull(), id_col, F.xxhash64(text_col))
    classes = rows.groupBy("k1", "k2", "n").agg(F.min_by(F.struct(*columns), order).alias("row"), F.count(F.lit(1)).alias("rows"))
    return blocked(classes.select("row.*", "rows", "n", "k1", "k2"), text_col)


def name_parts(tokens: np.ndarray, parts: int) -> np.ndarray:
    """A shingle's part, and 32 bits that tell it from the others there, in one number."""
    return (tokens >> U(32)) * U(parts) >> U(32) << U(32) | (mixed(tokens) & U(0xFFFFFFFF))


def rarity(rows: DataFrame, text_col: str, words: int, parts: int) -> DataFrame:
    """For each block the shingles that several classes hold, by part, with a code: 8 * log2 of how many, rounded, 1 at least."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in text_slices(batches, 1, SLICE_BYTES):
            block = batch.column(0).to_numpy()
            sets = shingle_sets(bytes_of(batch.column(1)), words)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                names = np.sort(name_parts(np.concatenate(sets[a:b]), parts))
                first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                names, count = names[first], np.diff(np.append(first, len(names))).astype("<u4")
                part = (names >> U(32)).astype(np.int32)
                at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = [*at[1:].tolist(), len(part)]
                low = names.astype("<u4")
                several = [(count[p:q] > 1).any() for p, q in zip(at.tolist(), ends, strict=True)]
                sent = [low[p:q].tobytes() for p, q in zip(at.tolist(), ends, strict=True)]
                counts = [count[p:q].tobytes() if some else None for p, q, some in zip(at.tolist(), ends, several, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block[a])), pa.array(part[at]), pa.array(sent, pa.binary()), pa.array(counts, pa.binary())], ["block", "part", "tokens", "codes"])

    def count(table: pa.Table) -> pa.Table:
        fresh()
        sent = [np.frombuffer(x, "<u4") for x in table.column("tokens").to_pylist()]
        counts = [np.ones(len(s), np.int64) if x is None else np.frombuffer(x, "<u4").astype(np.int64) for s, x in zip(sent, table.column("codes").to_pylist(), strict=True)]
        tokens = np.concatenate(sent)
        order = np.argsort(tokens, kind="stable")
        first = np.flatnonzero(np.append(True, tokens[order][1:] != tokens[order][:-1]))
        many = np.add.reduceat(np.concatenate(counts)[order], first)
        code = np.where(many > 1, np.clip(np.rint(8 * np.log2(many)), 1, 255), 0).astype(np.uint8)
        codes = np.empty(len(tokens), np.uint8)
        codes[order] = np.repeat(code, np.diff(np.append(first, len(order))))
        ends = np.cumsum([len(s) for s in sent])
        own = [(s, c) for s, c in zip(sent, np.split(codes, ends[:-1]), strict=True)]
        out = [(s[c > 0].tobytes(), c[c > 0].tobytes()) for s, c in own]
        told = pa.table({"block": table.column("block"), "part": table.column("part"), "tokens": pa.array([t for t, _ in out], pa.binary()), "codes": pa.array([c for _, c in out], pa.binary())})
        return told.filter(pa.array([bool(c) for _, c in out], pa.bool_()))

    return rows.select("block", text_col).mapInArrow(send, CODES).groupBy("part").applyInArrow(count, CODES)


def prefixes(rows: DataFrame, codes: DataFrame, text_col: str, words: int, least: tuple[int, int], parts: int) -> DataFrame:
    """cid, n, alone (shingles that no other class holds), what others may share of the prefix (token, pos in the order, code) and the whole set, of classes
    that may have a partner."""
    schema = "cid long, n int, alone int, prefix array<struct<token:long,pos:int,code:int>>, shingles binary"
    kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("code", pa.int32())]))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        fresh()
        out: list[tuple] = []
        names = [U(p) << U(32) | np.frombuffer(t, "<u4").astype(U) for p, t in zip(told.column("part").to_pylist(), told.column("tokens").to_pylist(), strict=True)]
        if names and docs.num_rows:
            names = np.concatenate(names)
            code = np.frombuffer(b"".join(told.column("codes").to_pylist()), np.uint8)
            order = np.argsort(names)
            names, code = names[order], code[order].astype(np.int32)
            slices = text_slices(docs.select(["cid", text_col]).combine_chunks().to_batches(), 1, SLICE_BYTES)
            for batch in slices:
                for cid, tokens in zip(batch.column(0).to_pylist(), shingle_sets(bytes_of(batch.column(1)), words), strict=True):
                    own = name_parts(tokens, parts)
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    found = np.where(names[at] == own, code[at], 0)
                    alone = len(tokens) - np.count_nonzero(found)
                    length = prefix_length(len(tokens), least)
                    if alone < length:
                        shared = np.flatnonzero(found)
                        first = shared[np.lexsort((tokens[shared], found[shared]))][: length - alone]
                        post = [{"token": t, "pos": alone + k, "code": c} for k, (t, c) in enumerate(zip(tokens[first].view(np.int64).tolist(), found[first].tolist(), strict=True))]
                        out.append((cid, len(tokens), alone, post, tokens.tobytes()))
        cids, n, alone, posts, sets = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({"cid": pa.array(cids, pa.int64()), "n": pa.array(n, pa.int32()), "alone": pa.array(alone, pa.int32()), "prefix": pa.array(posts, kind), "shingles": pa.array(sets, pa.binary())})

    return rows.select("block", "cid", text_col).groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, schema)


def copies(code: str) -> Column:
    """Parts that a shingle's posting list is dealt to: one per PART members or so, by its code alone."""
    return F.expr(f"cast(shiftleft(1L, greatest(0, cast(ceil({code} / 8.0) as int) - {PART.bit_length() - 1})) as int)")


def dealt(post: Column | str = "cid", code: str = "code") -> Column:
    return F.pmod(F.xxhash64(post), copies(code)).cast("int")


def pivot_pairs(postings: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b): each class with the pivots, PROPOSALS at most, that it shares most posted shingles with.

    A list's pivot is the member of which the least part is its own: what copies were made from rather than one of the copies.
    """
    order = F.struct((F.col("alone") / F.col("n")).alias("own"), F.hash("cid").alias("order"), "cid", "n", "pos")
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.max("code").alias("code"), F.min(order).alias("pivot")).where("many > 1")
    heads = lists.select("token", "pivot", F.explode(F.sequence(F.lit(0), copies("code") - 1)).alias("salt"))
    met = postings.withColumn("salt", dealt()).withColumn("own", F.struct("cid", "n", "pos")).join(heads, ["token", "salt"])
    met = met.where((F.col("own.cid") != F.col("pivot.cid")) & filters("own", "pivot", least))
    shared = met.groupBy(F.col("own.cid").alias("x"), F.col("pivot.cid").alias("y")).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y"))
    best = shared.withColumn("rank", rank).where(F.col("rank") <= PROPOSALS)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def crossing_pairs(postings: DataFrame, label: DataFrame, tested: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) not yet tested that share a posted shingle, are in different components and pass the filters."""
    held = postings.join(label.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed_lists = held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    held = held.join(mixed_lists, "token", "left_semi")
    # of a pair the smaller set (x) needs the shingle in the part of its prefix that sets of its size or more leave it
    x = held.where(F.expr(f"pos <= n - {needed_sql('n', 'n', least)}")).withColumn("salt", dealt()).alias("x")
    y = held.withColumn("salt", F.explode(F.sequence(F.lit(0), copies("code") - 1))).alias("y")
    smaller = F.expr("x.component <> y.component and (x.n < y.n or x.n = y.n and x.cid < y.cid)")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & smaller & filters("x", "y", least))
    pairs = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, each tested once on whole sets (cid, shingles)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), least) for x, y in both]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def class_components(rows: DataFrame, scratch: Scratch, text_col: str, words: int, least: tuple[int, int]) -> DataFrame:
    """node and component (cids) of the classes that have links."""
    total = rows.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    parts = -(-total // PART_SHINGLES) or 1
    codes = scratch.write(rarity(rows, text_col, words, parts))
    shared = scratch.write(prefixes(rows, codes, text_col, words, least, parts))
    scratch.drop(codes)
    postings = shared.select("cid", "n", "alone", F.explode("prefix").alias("x")).select("cid", "n", "alone", "x.token", "x.pos", "x.code")
    sets = shared.select("cid", "shingles")
    tested = scratch.write(pivot_pairs(postings, least))
    links = scratch.write(verified(tested, sets, least))
    label = components(links, scratch)
    more = scratch.write(verified(scratch.write(crossing_pairs(postings, label, tested, least)), sets, least))
    if not more.isEmpty():
        label = components(links.union(more), scratch)
    scratch.drop(shared)
    return label


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``df``: its id, n_shingles and component_id, the smallest id that links lead to.

    A null or empty text, or one without words, has no shingles and no link. Every row is a document of its own: rows that share an id are linked by their
    texts alone, and rows with equal sets are linked. Rows without an id link others, and get the component of those that have ids, or null.
    Ids must be whole numbers or texts of such. A very long text is worked on in blocks; its set is held by one task. An empty table gives no rows;
    other columns of ``df`` are not read, whatever their names.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.write(class_rows(docs, "id", "text", words))
    label = class_components(rows, scratch, "text", words, least)
    found = rows.select("k1", "k2", "n", "id", "rows", "cid").join(label.toDF("cid", "component"), "cid", "left")
    least_ids = found.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = found.join(least_ids, "component", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    told = linked.where("rows > 1 or component is not null").select("k1", "k2", "n", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = scratch.write(told)
    scratch.drop_all_but(told)
    own = keyed(docs, "text", ["id"], words).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = own.join(told, ["k1", "k2", "n", "salt"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``df`` that stay: of each group that links lead through one row, the one with the smallest id (nulls last, ties by content).

    Rows whose text has no word all stay. A repeated row stays once, and rows that share an id are told apart by their texts. Other columns are kept as
    they are, unless they are called as the working columns rows, n, k1, k2, cid or block: those are kept under other names meanwhile.
    """
    scratch = Scratch(df.sparkSession)
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    own = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    i, t = names[id_col], names[text_col]
    rows = scratch.write(class_rows(own, i, t, words))
    label = class_components(rows, scratch, t, words, least)
    linked = rows.select("cid", i, "k1").join(label.toDF("cid", "component"), "cid")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col(i).isNull(), i, "k1", "cid")).alias("first")).select("first.cid")
    gone = scratch.write(linked.select("cid").join(first, "cid", "left_anti"))
    scratch.drop_all_but(rows, gone)
    kept = rows.join(gone, "cid", "left_anti").select(*names.values())
    wordless = own.where(~F.coalesce(F.col(t), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.union(wordless).toDF(*df.columns)
