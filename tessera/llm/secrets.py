"""Secret scans by corpus-wide ownership frequency.

Every text is scanned for credentials of three fixed kinds (base spans) and for long tokens of mixed characters. The values' hashes are
counted over the whole corpus: by distinct repositories (documents, unless told otherwise) and by distinct owners (sources). A value in many
repositories or of several owners is a widely copied example; one in few repositories of few owners looks live. Live long tokens
become spans too, of the kind "owned". Regular expressions, counting and masking are Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

KINDS = ("assign", "access", "hex", "owned")
#: Owners, or repositories, from which a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10
#: Matches that are placed together; their places are then moved by what is before them.
CHUNK = 64
#: Parts that the places of one value are dealt to when they look up its owners.
SALTS = 32


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds' patterns. A value's own characters follow the last opening parenthesis.
NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # matches that are too short are prefixes of none that is long enough
HEX = r"[0-9a-f]{24,}"
LONG = r"[A-Za-z0-9+/_-]{32,}"
SHORTEST_VALUE = 6


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def ends_of(lengths: Column) -> Column:
    """Where each of the lengths ends if they follow each other: array<int>. Chunks are added up first, so a text with very many matches costs little more."""

    def running(x: Column) -> Column:
        step = lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))
        return F.aggregate(x, F.array().cast("array<int>"), step)

    def moved(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        return bound(before, lambda at: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda e: e + F.when(i > 0, F.get(at, i - 1)).otherwise(0)))))

    chunks = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / CHUNK).cast("int")), lambda c: running(F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))
    return bound(lengths, lambda x: bound(chunks(x), moved))


def places(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """array<struct<start, end, kind, value>> of a pattern's matches, in code points.

    The text between the matches comes from a split, so each match starts where the pieces and matches before it end.
    """

    def spans(found: Column) -> Column:
        value = lambda m: F.regexp_extract(m, pattern, value_group) if value_group else m
        lengths = F.transform(F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap")), lambda x: F.length(x["gap"]) + F.length(x["m"]))
        here = lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), value(x["m"]).alias("value"))
        return F.transform(F.arrays_zip(found.alias("m"), ends_of(lengths).alias("end")), here)

    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with base_ (spans) and long_ (long tokens of mixed characters that no base span overlaps), each with its value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(places(text, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= SHORTEST_VALUE)
    base = F.concat(assign, places(text, ACCESS, "access"), places(text, HEX, "hex"))
    mixed = F.filter(places(text, LONG, "owned"), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    out = df.select("*", base.alias("base_"), mixed.alias("mixed_"))
    apart = F.filter("mixed_", lambda x: ~F.exists("base_", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return out.withColumn("long_", apart).drop("mixed_")


def content() -> Column:
    """A hash of all that was found in a text, places and values."""
    return F.xxhash64(F.concat("base_", "long_"))


def classify(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, salts: int = SALTS) -> DataFrame:
    """id, content and spans: array<struct<start, order, end, kind, live, n_owners, n_repositories>> by start, then kind as listed; long tokens only if live.

    ``scanned`` has id, owner, base_ and long_; rows without a candidate give none. Values are counted in steps (by value, owner and document; by value
    and owner; by value), each pre-aggregated before its shuffle. The counts go back to a value's places by value and salt, so a value that a third
    of the rows hold is dealt to ``salts`` parts. Rows are told apart by id and content.
    """
    rows = scanned.withColumn("all_", F.concat("base_", "long_")).where("size(all_) > 0").select("id", "owner", content().alias("content"), "all_")
    each = rows.select("id", "owner", "content", F.explode("all_").alias("x"))
    each = each.select("id", "owner", "content", "x.start", "x.end", "x.kind", F.sha2(F.col("x.value").cast("binary"), 256).alias("hash"))
    # a document of two owners (rows that share an id) counts as a repository of each
    by_repository = each.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), "id").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("one").alias("n"))
    held = by_owner.groupBy("hash").agg(F.count("n").alias("n_owners"), F.sum("n").alias("n_repositories"))
    dealt = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("id", "content"), F.lit(salts)).cast("int"))
    live = (F.col("n_owners") < example_owners) & (F.col("n_repositories") < example_repositories)
    seen = salted.join(dealt, ["hash", "salt"]).withColumn("live", live).where("kind <> 'owned' or live")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", "kind", "live", "n_owners", "n_repositories")
    return seen.groupBy("id", "content").agg(F.array_sort(F.collect_set(span)).alias("spans"))


SPANS = "array<struct<start:int,order:bigint,end:int,kind:string,live:boolean,n_owners:bigint,n_repositories:bigint>>"


def with_spans(found: DataFrame, told: DataFrame, id_col: str) -> DataFrame:
    """Adds spans to scanned rows. Rows without a candidate are not joined."""
    found = found.withColumn("content_", content())
    none = found.where("size(base_) + size(long_) = 0").withColumn("spans", F.array().cast(SPANS))
    some = found.where("size(base_) + size(long_) > 0")
    told = told.toDF("told_id_", "told_content_", "spans")
    joined = some.join(told, some[id_col].eqNullSafe(F.col("told_id_")) & (F.col("content_") == F.col("told_content_")), "left")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return none.union(joined.select(none.columns)).drop("content_")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per row of ``df``: id, base (the base spans with their values) and spans (all spans, each with live and both counts).

    The scan reads each text once; what it finds is written to shared storage, and corpus-wide steps work on that. A null or empty text has no spans, a null
    id or owner counts as a value of its own, repeated rows get the same spans each (one owner still counts once), rows that share an id are told apart by
    what their texts hold, an empty table gives no rows; other columns of ``df`` are not read, whatever their names.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = scratch.write(scan(docs).drop("text"))
    out = with_spans(found, classify(found, example_owners, example_repositories), "id")
    return out.select(F.col("id").alias(id_col), F.col("base_").alias("base"), "spans")


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", length_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """The rows of ``df``, each once, with live spans masked in the text; ``length_col``, if named, follows a masked text.

    The scan is written with its row, so a text is masked by its own spans: null ids, repeated rows and rows that share an id are no exception. Null and empty
    texts stay as they are; an empty table gives no rows; all columns keep their names and values, also those called as the working ones.
    """
    scratch = Scratch(df.sparkSession)
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    i, t, o = names[id_col], names[text_col], names[owner_col]
    found = scratch.write(scan(df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), t))
    told = classify(found.select(F.col(i).alias("id"), F.col(o).cast("string").alias("owner"), "base_", "long_"), example_owners, example_repositories)
    rows = with_spans(found, told, i).withColumn("live_", F.filter("spans", lambda x: x["live"]))
    rows = rows.withColumn("masked_", F.when(F.size("live_") > 0, mask(F.col(t), F.col("live_"))))
    new = {t: F.coalesce("masked_", t)}
    if length_col:
        n = names[length_col]
        new[n] = F.when(F.col("masked_").isNull(), F.col(n)).otherwise(F.length("masked_")).cast(df.schema[length_col].dataType)
    return rows.select(*(new.get(n, F.col(n)).alias(c) for c, n in names.items()))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    counts = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["n_owners"].cast("string"), x["n_repositories"].cast("string"))), ",")
    live = lambda yes: F.size(F.filter("spans", lambda x: x["live"] if yes else ~x["live"])).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        counts.alias("owners_repositories"),
        live(True).alias("n_live"),
        live(False).alias("n_examples"),
    )


def mask(text: Column, spans: Column, by: str = "<SECRET>") -> Column:
    """The text with each run of overlapping spans replaced; spans are sorted by start. A null text stays null, and so does one with null spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        later = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(by)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((x["start"] < acc["at"]), inside).otherwise(later)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def oracle() -> str:
    """The same in DuckDB: spans from split and extracted lists, owners counted over all rows."""

    def spans(pattern: str, kind: str, order: int, test: str, group: int = 0) -> str:
        pattern = pattern.replace("'", "''")
        return f"""select doc_id, source, t, '{kind}' as kind, {order} as ord, v, e - length(m) as s, e from (
          select *, sum(length(g) + length(m)) over (partition by doc_id, source, t order by i rows unbounded preceding)::bigint as e from (
            select doc_id, source, t, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(vs) as v, unnest(gs[1:len(ms)]) as g from (
              select distinct doc_id, source, t, regexp_extract_all(t, '{pattern}', 0) as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, string_split_regex(t, '{pattern}') as gs
              from d where regexp_matches(t, '{pattern}')))) where {test}"""

    return f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
base as ({spans(ASSIGN, "assign", 1, f"length(v) >= {SHORTEST_VALUE}", 2)}
  union all {spans(ACCESS, "access", 2, "true")}
  union all {spans(HEX, "hex", 3, "true")}),
mixed as ({spans(LONG, "owned", 4, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')")}),
long as (select * from mixed x where not exists (select 1 from base b where b.doc_id = x.doc_id and b.t = x.t and x.s < b.e and b.s < x.e)),
every as (select * from base union all select * from long),
held as (select v, coalesce(source, '') as owner, count(distinct coalesce(doc_id::varchar, '')) as n from every group by all),
owners as (select v, count(*) as n_owners, sum(n)::bigint as n_repositories from held group by v),
judged as (select *, n_owners < {EXAMPLE_OWNERS} and n_repositories < {EXAMPLE_REPOSITORIES} as live from every join owners using (v)),
spans as (select * from judged where kind <> 'owned' or live),
digest as (select doc_id, t,
  count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (where kind <> 'owned') as base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans,
  string_agg(n_owners || ':' || n_repositories, ',' order by s, ord) as owners_repositories,
  count(*) filter (where live) as n_live, count(*) filter (where not live) as n_examples
  from spans group by doc_id, t)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(owners_repositories, '') as owners_repositories, coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples
from d left join digest on d.doc_id = digest.doc_id and d.t = digest.t
"""
