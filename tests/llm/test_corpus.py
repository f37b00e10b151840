"""Exact dedup, secrets, similarity join, language ID, suffix dedup, TIFF and the pipeline, on small fixtures with odd rows."""

import collections
import functools
import hashlib
import os
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import corpus_pipeline
from tessera.llm import exact_dedup, graph, language, ngram_join, secrets, suffix_dedup, tiff

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, keep_id string, spans int, n int, component int, batch string"


def frame(spark, rows, **more):
    return spark.createDataFrame([(i, t, *(s or ("s", "en")), len(t or ""), "x", 1, 2, 3, "y") for i, t, *s in [(r[0], r[1], *r[2:]) for r in rows] for s in [tuple(s) if s else None]], SCHEMA).repartition(3)


# exact dedup


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (9, "a"), (2, None), (3, ""), (4, "A"), (7, "b" * 100_000), (8, "b" * 100_000), (9, "a"), (None, "a"), (None, "z")]
    want = collections.defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = sorted(str(tuple(r)) for r in exact_dedup.exact_groups(frame(spark, rows), keep=keep).collect())
        stays = {t: pick([i for i in ids if i is not None], default=None) for t, ids in want.items()}
        assert got == sorted(str((i, stays[t or ""], len(want[t or ""]), i == stays[t or ""], hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)
        kept = exact_dedup.drop_copies(frame(spark, rows), keep=keep)
        assert kept.columns == frame(spark, rows).columns
        assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect() if r["text"]) == sorted(str((stays[t], t)) for t in want if t)
        assert {r["doc_id"] for r in kept.collect() if not r["text"]} == {stays[""]}
    assert exact_dedup.exact_groups(frame(spark, rows).where("false")).collect() == []


def test_a_group_of_copies_larger_than_all_others(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_groups(frame(spark, rows), keep="largest").where("group_size > 1").collect()
    assert len(got) == 2000 and {r["keep_id"] for r in got} == {2999} and sum(r["kept"] for r in got) == 1


# secrets


def base_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 1, m.end(), "assign"))
    out += [(m.start(), 2, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 3, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef00", "é", "🙂", "\n", "==", "-x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "secret=token:abcdefgh", "AKIA" * 9, "é🙂token = 'a.b/c+d=='", "f" * 50_000]
    got = {r["doc_id"]: r for r in secrets.digests(secrets.find_secrets(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(want.count(k) for k in ("assign", "access", "hex"))
        assert ",".join(x for x in got[i]["spans"].split(",") if x and not x.startswith("owned")) == want


def test_owners_part_examples_from_live_values(spark):
    shared, own, long = "token=EXAMPLEKEY123", "password: hunter2hunter2", "Ab1" * 12
    rows = [(i, f"x {shared} y", f"s{i}", "en") for i in range(6)] + [(10, f"{own} {long}", "s1", "en"), (10, f"{own} {long}", "s1", "en"), (11, own, None, "en"), (None, own, "s1", "en")]
    got = secrets.find_secrets(frame(spark, rows))
    spans = {(r["doc_id"], s["kind"]): s["live"] for r in got.collect() for s in r["spans"]}
    assert spans == {**{(i, "assign"): False for i in range(6)}, (10, "assign"): True, (10, "owned"): True, (11, "assign"): True, (None, "assign"): True}
    assert got.count() == len(rows) and secrets.find_secrets(frame(spark, rows).where("false")).count() == 0


def test_owners_and_repositories_each_decide(spark):
    value = "AKIA" + "Q" * 16
    live = lambda rows: {s["live"] for r in secrets.find_secrets(frame(spark, rows)).collect() for s in r["spans"]}
    of_two = [(i, f"key {value}", "ab"[i % 2], "en") for i in range(secrets.EXAMPLE_REPOSITORIES - 1)]
    assert live(of_two) == {True}
    assert live([*of_two, (50, value, "c", "en")]) == {False}  # three owners
    assert live([*of_two, *of_two, *of_two]) == {True}  # repeated rows are no further repositories
    one = [(i, f"key {value}", "a", "en") for i in range(secrets.EXAMPLE_REPOSITORIES)]
    assert live(one) == {False} and live(one[1:]) == {True}  # one owner, many repositories


def test_very_many_matches(spark):
    text = " ".join(f"{i:024x}é" for i in range(5000))
    got = secrets.digests(secrets.find_secrets(frame(spark, [(1, text)]))).first()
    assert got["n_hex"] == 5000 and got["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest()


def test_mask_secrets(spark):
    rows = [(None, "password = hunter2secretA"), (7, "one token=AAAAAAA11 end"), (7, "long before api_key=ZZZZZZ99 end"), (8, "nothing"), (9, None), (10, ""), (7, "one token=AAAAAAA11 end"), (11, "x " * 100_000 + "secret: 0123456789ab")]
    docs = frame(spark, rows)
    got = secrets.mask_secrets(docs, length_col="n_chars")
    assert got.columns == docs.columns
    cut = "<SECRET>"
    want = [(None, cut), (7, f"one {cut} end"), (7, f"long before {cut} end"), (8, "nothing"), (9, None), (10, ""), (7, f"one {cut} end"), (11, "x " * 100_000 + cut)]
    assert sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in got.collect()) == sorted(str((i, t, len(t or ""))) for i, t in want)
    assert secrets.mask_secrets(docs.where("false")).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "n as spans", "n as base_", "n as live", "n as `content_`", "n as id")
    assert sorted(str(tuple(r)) for r in secrets.mask_secrets(clash).collect()) == sorted(str((i, t, "s", 2, 2, 2, 2, 2)) for i, t in want)


def test_mask(spark):
    text = "é token=0123456789abcdef0123456789abcdef! end"
    df = frame(spark, [(1, text)])
    spans = secrets.find_secrets(df).select("doc_id", "spans")
    got = df.select("doc_id", "text").join(spans, "doc_id").select(secrets.mask(df["text"], spans["spans"])).first()[0]
    assert got == "é <SECRET>! end"


# similarity join


def similar_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


def similar_rows(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(rng.randrange(1, 4)))
    passage = [word() for _ in range(40)]
    seeds = [[word() for _ in range(rng.choice([3, 5, 8, 30, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(seeds)) if rng.random() < 0.8 else [word() for _ in range(30)] + passage
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word().upper()
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, (1, None), (2, ""), (4, " \n "), (7, "One two"), (10, "one  TWO"), (13, "word " * 3000), (16, "word " * 3001)]


@pytest.mark.parametrize(("seed", "part"), [(1, 512), (2, 1)])
def test_similar_groups(spark, monkeypatch, seed, part):
    monkeypatch.setattr(ngram_join, "PART", part)  # 1: every list is dealt to parts
    rows = similar_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame(spark, rows)).collect()}
    assert got == similar_by_brute_force(rows)


def test_similar_groups_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (9, text.upper()), (None, text), (None, "quite another text of seven words here"), (2, "x")]
    got = sorted(str(tuple(r)) for r in ngram_join.similar_groups(frame(spark, rows)).collect())
    assert got == sorted(str(x) for x in [(5, 3, 5), (5, 3, 5), (9, 3, 5), (None, 3, 5), (None, 3, None), (2, 1, 2)])
    assert ngram_join.similar_groups(frame(spark, rows).where("false")).count() == 0
    assert {r["component_id"] for r in ngram_join.similar_groups(frame(spark, [(1, None), (2, "")])).collect()} == {1, 2}


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rows, seen = similar_rows(3, 200), []
    test = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: seen.append([tuple(r) for r in pairs.collect()]) or test(pairs, *rest))
    monkeypatch.setattr(ngram_join, "PROPOSALS", 1)  # so that the second pass has work to do
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame(spark, rows)).collect()}
    assert got == similar_by_brute_force(rows)
    pairs = [p for part in seen for p in part]
    assert len(seen) == 2 and pairs and len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)


def test_small_blocks_and_parts_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 500), ("SLICE_BYTES", 200), ("PART_SHINGLES", 100)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = similar_rows(4, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame(spark, rows)).collect()}
    assert got == similar_by_brute_force(rows)


def test_shingles_in_blocks(monkeypatch):
    from tessera.llm import shingles

    texts = [b"", b" ", b"A b", b"word " * 50, b"x" * 300 + b" a b c d e f", b"\tSeventeen_letters_word\n", b"a b c d " + b"y" * 100, b"aBcDeFgH aBcDeFgHi"]
    whole = [x.tolist() for x in shingles.shingle_sets(texts)]
    assert [len(x) for x in whole] == [0, 0, 1, 1, 3, 1, 1, 1]
    for size in (1, 7, 40):
        monkeypatch.setattr(shingles.blocks, "__defaults__", (size,))
        assert [x.tolist() for x in shingles.shingle_sets(texts)] == whole
    assert shingles.shingle_sets([b"abcdefgh"])[0] != shingles.shingle_sets([b"abcdefgh\0"])[0]


def test_keep_one(spark):
    text = "a b c d e f g"
    other = "quite another text of seven words here"
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, other), (2, "x"), (4, ""), (4, None), (4, " "), (5, "p q r s t u v w x y z"), (9, "p q r s t u v w x y z")]
    docs = frame(spark, rows).selectExpr("*", "n as rows", "n as cid", "n as block", "n as k1")
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, [(3, text.upper()), (None, other), (2, "x"), (4, ""), (4, None), (4, " "), (5, "p q r s t u v w x y z")]))
    assert ngram_join.keep_one(docs.where("false")).count() == 0


def test_suffix_bound_is_a_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in "ab")
        assert len(np.intersect1d(x, y)) <= ngram_join.suffix_bound(x, y) <= min(len(x), len(y))
    for nx in range(1, 40):
        for ny in range(1, 40):
            least = next(i for i in range(100) if 100 * i >= 75 * (nx + ny - i))
            assert ngram_join.needed(nx, ny) == least


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 1), (20, 21)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, **{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 700)}}


# language ID


def test_language(spark):
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(1000, None, "s", "en"), (1001, "", "s", "en"), (1002, "12 345 !!", "s", "fr"), (1003, "the and of " * 5000, "s", None), (None, "le la les des", "s", "fr")]
    got = {r["doc_id"]: r for r in language.predictions(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "en"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None) and not got[None]["held_out"]
    held = [(got[i]["lang_pred"], l) for i, t, _, l in rows if i is not None and i < 1000 and got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.predictions(frame(spark, [(1, "abc", "s", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
    assert language.predictions(frame(spark, rows).where("false")).count() == 0


def test_grams_equal_plain_counting():
    for text in ("Ab, ab c", "é'é  ñandú", "x", "", "123", "a" * 100):
        want = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for n in (1, 2, 3):
                padded = word if n == 1 else f"\1{word}\1"
                want.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        codes, counts = language.grams(text)
        decode = lambda c: "".join(chr(c >> s & (1 << 21) - 1) for s in (42, 21, 0)).lstrip("\0")
        got = {decode(int(c)): int(n) for c, n in zip(codes, counts, strict=True)}
        assert got == want


def plain_prediction(text, profiles):
    """Rank-order profiles in plain Python: the nearest profile, and how near it is."""
    found = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (1, 2, 3):
            padded = word if n == 1 else f"\1{word}\1"
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    number = lambda g: functools.reduce(lambda a, c: a << 21 | ord(c), g, 0)
    own = sorted(found, key=lambda g: (-found[g], number(g)))[: language.PROFILE]
    if not own or not profiles:
        return "und", 0.0
    distance = {}
    for name, profile in profiles.items():
        rank = {g: i for i, g in enumerate(profile)}
        distance[name] = sum(abs(rank[number(g)] - i) if number(g) in rank else language.PROFILE for i, g in enumerate(own))
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (language.PROFILE * len(own))


def test_predictions_equal_plain_distances(spark):
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:150]
    rows += [(2000, "Ünïcödé 漢字 word", "s", "de"), (2001, "a", "s", "en"), (2002, None, "s", None)]
    docs = frame(spark, rows)
    profiles = language.fit(docs.where(~language.held_out()))
    counted = collections.defaultdict(collections.Counter)
    for i, t, _, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            codes, n = language.grams(t)
            counted[lang].update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert profiles == {lang: sorted(c, key=lambda g: (-c[g], g))[: language.PROFILE] for lang, c in counted.items() if c}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predictions(docs).collect()}
    for i, t, *_ in rows:
        want = plain_prediction(t or "", profiles)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-12), t


# suffix dedup


def repeated_rows(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [letters(rng.choice([40, 49, 50, 51, 60, 120, 300])) for _ in range(20)] + ["ab" * 60, "x" * 200]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else letters(rng.choice([1, 10, 40, 100])) for _ in range(rng.choice([0, 1, 3, 6])))
        rows.append((i * 2, text))
    return rows


@pytest.mark.parametrize(("seed", "many"), [(1, 512), (2, 2)])
def test_remove_repeats(spark, monkeypatch, seed, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)  # 2: mixed buckets are dealt out by window
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    rows = repeated_rows(seed)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect()}
    assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in rows])


def test_remove_repeats_odd_rows(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    rows = [(5, text), (5, text), (7, "z" + text), (None, text), (1, None), (2, ""), (3, "short"), (9, "y" * 200_000)]
    got = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"])) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted(map(str, [(5, 80, 80, 1), (5, 80, 80, 1), (7, 81, 80, 1), (None, 80, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (9, 200_000, 0, 0)]))
    assert suffix_dedup.remove_repeats(frame(spark, rows).where("false")).count() == 0


def shuffled(spark, run):
    """The result of run(), and the bytes that its shuffles wrote."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    return run(), written() - before


def test_remove_repeats_sends_little_of_common_words(spark):
    rng = random.Random(4)
    words = [rng.randbytes(rng.choice([2, 3, 4, 5])).hex() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(1000))) for i in range(400)]
    rows += [(i + 1000, rng.randbytes(100).hex() + t[200:400] + rng.randbytes(100).hex()) for i, t in rows[:20]]
    got, sent = shuffled(spark, lambda: suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect())
    assert {r[0]: tuple(r[1:]) for r in got} == suffix_dedup.brute_force([(i, t.encode()) for i, t in rows])
    assert sent < 1.2 * sum(len(t) for _, t in rows)  # most 20-byte strings are in several documents, few 35-byte ones are


def mixed_bytes(texts, batches):
    """Bytes of texts that batches send to be refined, all steps before run as Spark would run them; text i goes to batch i % batches."""
    dealt = pa.table({"batch": pa.array([i % batches for i in range(len(texts))], pa.int32()), "id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    docs = {b: pa.Table.from_batches(list(suffix_dedup.deal(iter(dealt.filter(pc.equal(dealt["batch"], b)).combine_chunks().to_batches())))) for b in range(batches)}
    parts = 2 * batches

    def told(sent, by, judge, what):
        sent = pa.concat_tables(sent)
        out = pa.concat_tables([judge(sent.filter(pc.equal(sent[by], p))) for p in sorted(set(sent[by].to_pylist()))])
        return out.append_column("what", pa.array([what] * out.num_rows, pa.int32()))

    at = lambda t, b: t.filter(pc.equal(t["batch"], b))
    sides = told([suffix_dedup.send_sides(t, parts) for t in docs.values()], "part", suffix_dedup.judge_sides, suffix_dedup.SIDES)
    anchors = told([suffix_dedup.send_segments(t, at(sides, b), parts) for b, t in docs.items()], "part", suffix_dedup.judge_anchors, suffix_dedup.ANCHORS)
    both = pa.concat_tables([sides, anchors])
    sent = [suffix_dedup.send_mixed(t, at(both, b), parts) for b, t in docs.items()]
    return sum(len(suffix_dedup.unpacked(m, np.uint32, np.uint64, np.int32, np.int64, np.int64)[5]) for t in sent for m in suffix_dedup.messages(t))


def test_mixed_buckets_are_sent_once_and_whole():
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    x = letters(3000)
    y = "".join(c if i % 61 else "." for i, c in enumerate(x))
    assert 0 < mixed_bytes([x, y] * 20, 5) == mixed_bytes([x, y] * 20, 1)  # two contents an anchor, each in four batches or more
    line = letters(60)
    lines = [letters(60) + line + letters(60) for _ in range(700)]
    assert 0 < mixed_bytes(lines, 1) < 2 * sum(map(len, lines))  # some 700 contents an anchor; as windows they are five times the texts


# TIFF


def test_codecs():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 576, 4000, 70_000):
        for data in (bytes(rng.choice(b"ab") for _ in range(n)), os.urandom(n), b"a" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
            assert b"".join(p["pixels"] for p in tiff.pages(tiff.write(data))) == tiff.padded(data)
    # known vectors: the PackBits note's own example, and a short LZW stream packed by hand
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes, bits = [256, 7, 258, 8, 8, 257], 0
    for c in codes:
        bits = bits << 9 | c
    assert tiff.lzw_decode((bits << 2).to_bytes(7, "big")) == bytes([7, 7, 7, 8, 8])


def test_all_layouts_and_byte_orders():
    seen = set()
    for rows in range(1, 9):
        for p in tiff.pages(tiff.write(os.urandom(tiff.ROW * rows))):
            seen.add((p["compression"], p["predictor"] == 2, p["tiled"]))
    assert seen == set(tiff.LAYOUTS)
    entries = [(256, 3, 2), (257, 3, 1), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (278, 3, 1), (279, 4, 4), (317, 3, 2)]
    body = b"MM\0*" + (12).to_bytes(4, "big") + bytes([1, 0, 0, 5]) + len(entries).to_bytes(2, "big")
    body += b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + (1).to_bytes(4, "big") + (v.to_bytes(2, "big") + b"\0\0" if k == 3 else v.to_bytes(4, "big")) for t, k, v in entries) + bytes(4)
    (p,) = tiff.pages(body)
    assert p["pixels"] == (256).to_bytes(2, "little") + (261).to_bytes(2, "little")


def test_media_queries(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 60_000), (1, "hello"), (None, "hello")]
    got = tiff.digests(tiff.read_pages(tiff.write_media(frame(spark, rows)), ["doc_id", "n_bytes"])).collect()
    assert len(got) == len(rows)
    for r, text in ((next(r for r in got if r["doc_id"] == i), t) for i, t in rows):
        payload = tiff.padded((text or "").encode())
        media = tiff.write((text or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r["feature"] for r in got if r["n_bytes"] == 5}) == 1
    assert tiff.write_media(frame(spark, rows).where("false")).count() == 0


def plain_tiff(data):
    """A small reader of 8-bit gray TIFF files for comparison: the samples of all pages."""
    word = lambda form, at: struct.unpack_from("<" + form, data, at)[0]
    assert data[:4] == b"II*\0"
    at, out, layouts = word("I", 4), [], set()
    while at:
        tags = {}
        for e in range(at + 2, at + 2 + 12 * word("H", at), 12):
            tag, kind, n, value = struct.unpack_from("<HHII", data, e)
            assert kind == 4
            tags[tag] = [value] if n == 1 else list(struct.unpack_from(f"<{n}I", data, value))
        width, height = tags[256][0], tags[257][0]
        tiled = 324 in tags
        w, h = (tags[322][0], tags[323][0]) if tiled else (width, tags[278][0])
        grid = [bytearray(width) for _ in range(height)]
        for k, (a, n) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
            part = data[a : a + n]
            compression = tags[259][0]
            if compression == 8:
                part = zlib.decompress(part)
            elif compression == 32773:
                raw, part, p = part, bytearray(), 0
                while p < len(raw):
                    n = raw[p] - 256 * (raw[p] > 127)
                    part += raw[p + 1 : p + 2 + n] if n >= 0 else raw[p + 1 : p + 2] * (1 - n)
                    p += n + 2 if n >= 0 else 2
            elif compression == 5:
                bits, p, size, part, table, last = int.from_bytes(part, "big"), 8 * len(part), 9, bytearray(), [], None
                while True:
                    p -= size
                    code = bits >> p & (1 << size) - 1
                    if code == 257:
                        break
                    if code == 256:
                        table, size, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, None
                        continue
                    entry = table[code] if code < len(table) else last + last[:1]
                    if last is not None:
                        table.append(last + entry[:1])
                    part += entry
                    last = entry
                    size = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
            across = -(-width // w)
            top, left = k // across * h, k % across * w
            for y in range(min(h, height - top)):
                row = bytearray(part[y * w : (y + 1) * w])
                if tags[317][0] == 2:
                    for x in range(1, w):
                        row[x] = (row[x] + row[x - 1]) % 256
                grid[top + y][left : left + w] = row[: width - left]
        layouts.add(f"{tags[259][0]}{'p' if tags[317][0] == 2 else ''}{'t' if tiled else ''}")
        out += grid
        at = word("I", at + 2 + 12 * word("H", at))
    return b"".join(out), layouts


def test_media_against_a_plain_reader(spark):
    rng = random.Random(5)
    texts = ["", "hello", "é" * 60_000, "ab" * 150_000, *("".join(rng.choice("abc déf\n") for _ in range(rng.randrange(30_000))) for _ in range(12))]
    docs = frame(spark, list(enumerate(texts)))
    media = {r["doc_id"]: bytes(r["media"]) for r in tiff.write_media(docs).collect()}
    got = {r["doc_id"]: r for r in tiff.digests(tiff.read_pages(tiff.write_media(docs), ["doc_id", "n_bytes"])).collect()}
    for i, t in enumerate(texts):
        payload = t.encode() + b"\xff" * (576 if not t else -len(t.encode()) % 576)
        pixels, layouts = plain_tiff(media[i])
        assert pixels == payload and got[i]["error"] is None
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        feature = dict(x.split("=") for x in got[i]["feature"].split(";"))
        mean = sum(payload) / len(payload)
        variance = sum((b - mean) ** 2 for b in payload) / len(payload)
        assert int(feature["pages"]) == -(-len(payload) // (576 * 64)) and set(feature["layouts"].split("+")) == layouts
        assert float(feature["mean"]) == pytest.approx(mean, abs=1e-4) and float(feature["var"]) == pytest.approx(variance, abs=1e-3)
        assert feature["hist"] == ",".join(str(sum(payload.count(b) for b in range(k, k + 32))) for k in range(0, 256, 32))


def test_digests_of_bad_files(spark):
    good = tiff.write(b"abc" * 50_000)
    df = spark.createDataFrame([("a", 1, b"GIF"), ("b", 2, good), (None, 3, None), ("c", 4, good)], "k string, n_bytes long, media binary").coalesce(1)
    pages = tiff.read_pages(df, ["k", "n_bytes"]).where("not (k = 'b' and page = 2)")
    got = {r["k"]: r for r in tiff.digests(pages, "k").collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"]["error"] is None and got["c"]["payload_bytes"] == len(tiff.padded(b"abc" * 50_000))
    assert all(got[k]["error"] and got[k]["payload_sha256"] is None for k in ("a", "b", None))


def test_bad_files_give_a_row_that_says_so(spark):
    good = tiff.write(b"abc")
    loop = good[:-4] + good[4:8]
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"GIF89a.."), (4, good[:40]), (5, loop), (6, good)], "k long, media binary")
    got = {r["k"]: r for r in tiff.read_pages(df, ["k"]).collect()}
    assert [got[k]["page"] for k in range(1, 7)] == [-1, -1, -1, -1, -1, 0] and all(got[k]["error"] for k in range(1, 6))


# pipeline


def test_too_many_languages_are_an_error(spark, monkeypatch):
    docs = frame(spark, [(1, "ab", "s", "aa"), (2, "cd", "s", "bb"), (3, "ef", "s", "cc")])
    whole = language.fit(docs, profile=4)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    assert language.fit(docs, profile=4) == whole and [len(p) for p in whole.values()] == [4, 4, 4]
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="2 languages"):
        language.fit(docs, profile=4)


def test_language_stage_without_profiles(spark):
    texts = ["abc", "漢字", "x 1", "12 !!", "", None, "ꟊ"]
    docs = frame(spark, [(i, t, "s", None) for i, t in enumerate(texts)])
    told = corpus_pipeline.identify_language(spark, docs, DATA)
    assert told.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r["doc_id"], r["text"]) for r in told.collect()) == [(i, texts[i]) for i in (0, 1, 2, 6)]
    only_held_out = [i for i in range(100) if language.is_held_out(i)]
    labelled = frame(spark, [(i, "abc", "s", "en") for i in only_held_out])
    assert corpus_pipeline.identify_language(spark, labelled, DATA).count() == len(only_held_out)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    odd = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "123 !!", "en", "s", 7), (9002, "", "en", "s", 0)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    told = stages["language ID"](spark, docs.union(odd), DATA)
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} == set(rows)
    kept = stages["exact dedup"](spark, told, DATA)
    latest = {r["text"]: i for i, r in sorted(rows.items())}
    assert {r["doc_id"] for r in kept.collect()} == set(latest.values())
    left = stages["n-gram Jaccard join"](spark, kept, DATA)
    groups = {i: c for i, (_, c) in similar_by_brute_force([(r["doc_id"], r["text"]) for r in kept.collect()]).items()}
    assert {r["doc_id"] for r in left.collect()} == set(groups.values())
    masked = {r["doc_id"]: r for r in stages["secret scans"](spark, left, DATA).collect()}
    assert set(masked) == set(groups.values())
    for i, r in masked.items():
        assert r["n_chars"] == len(r["text"]) if "<SECRET>" in r["text"] else r["text"] == rows[i]["text"]
    check_pieces(corpus_pipeline.run(spark, DATA).collect(), {i: r["text"] for i, r in masked.items()})


def check_pieces(pieces, texts):
    """Pieces are the binary lengths of each text's ids by the library, with the end id, in order."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            n = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            want.add((i, start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n])), len(ids), 0))
            start += n
    got = [(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], p["offset"]) for p in pieces]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({p["sequence_id"] for p in pieces}) == len(pieces)


def test_pipeline_odd_rows(spark):
    prose = "the old house by the sea had seen many better days than this one"
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (None, "quite other words password = hunter2secretA", "s1", "en"),
        (7, "one token=AAAAAAA11 end", "s1", "en"),
        (7, "long before api_key=ZZZZZZ99 end", "s1", None),
        (7, "long before api_key=ZZZZZZ99 end", "s2", "en"),
        (8, prose, "s1", "en"),
        (9, prose.upper(), "s1", "en"),
        (10, long, "s1", "en"),
        (11, long + " more", "s2", "en"),
        (12, None, "s1", "en"),
        (13, "12 !!", "s1", "en"),
        (None, None, None, None),
    ]
    docs = frame(spark, rows).selectExpr("*", "n as rows", "n as base_", "n as k1")
    cut = "<SECRET>"
    want = [(None, f"quite other words {cut}"), (7, f"one {cut} end"), (7, f"long before {cut} end"), (8, prose), (10, long)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    got = docs.collect()
    assert sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in got) == sorted(str((i, t, len(t))) for i, t in want)
    assert corpus_pipeline.pack(spark, docs, DATA).select("doc_id").distinct().count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, rows).where("false"), DATA).count() == 0
