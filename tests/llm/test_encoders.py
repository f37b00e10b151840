"""Token counts, piece ids, word ids, packing and ORC files against the libraries; odd inputs for each."""

import hashlib
import random
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import orc_ids, packing, piece_codec, token_counts, word_ids

random.seed(11)
POOLS = ("ab ", "aA1 '  \n\tst", "thei an", "é ▁ a　 \x1c\x85", "0123456789abcdef", "=-_# !", "aEé's'll don t1,.;²İœ  ", "ΑΣ. ́x ſK", "<|endoftext|>")
TEXTS = ["".join(random.choice(pool) for _ in range(random.choice([1, 5, 20, 80]))) for pool in POOLS for _ in range(40)]
TEXTS += ["", " ", "  a  ", "\n" * 40, " " * 100, "a" * 400, "x" * 5000, "abcdefgh" * 3000, "<|endoftext|>", "a<|endoftext|><|EndOfText|> b", "<s></s><unk>", "\x00a\x00", "漢字かな交じり文 و العربية 🙂👍🏽", "The quick brown fox, the lazy dog."]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (0, TEXTS[0]), (0, TEXTS[0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "other", 1, 2.0) for i, t in ROWS], "doc_id long, text string, n_tokens string, ids int, start double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_counts_equal_the_library(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(str((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)) for i, t in ROWS)
    assert sorted(str(tuple(r)) for r in token_counts.count_tokens(docs).collect()) == want
    assert token_counts.count_tokens(empty).collect() == []


def test_pieces_equal_the_library(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = piece_codec.encode_pieces(docs)
    want = sorted(str((i, library.encode(t or ""), library.decode(library.encode(t or "")))) for i, t in ROWS)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    row = piece_codec.digests(got).where("doc_id = 1").first()
    ids = library.encode(TEXTS[1])
    assert tuple(row) == (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got.where("doc_id is null").count() == 1 and piece_codec.encode_pieces(empty).count() == 0


def test_compatibility_equals_merging():
    m = piece_codec.PieceModel(piece_codec.DEFAULT_MODEL)
    rng = random.Random(5)
    tokens = list(m.ids.values())
    spaces = [i for p, i in m.ids.items() if set(p) == {"▁"}]
    pairs = [(rng.choice(tokens[:4000]), rng.choice(tokens[:4000])) for _ in range(5000)] + [(rng.choice(tokens), rng.choice(tokens)) for _ in range(5000)] + [(a, b) for a in spaces for b in spaces]
    for a, b in pairs:
        pair = [m.pieces[a], m.pieces[b]]
        assert m.compatible(a, b) == (m.merge("".join(pair)) == pair), pair


def word_id_lists():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS]


def test_word_ids_equal_the_library():
    got = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY).encode([(t or "").encode() for _, t in ROWS])
    assert [g.tolist() for g in got] == [ids for _, ids in word_id_lists()]


@pytest.mark.parametrize("text", ["IT'S <|endoftext|> ok", "F# <| DON'T x", "WE'LL, <|endoftext|>THEY'RE I'M <| I'VE HE'D É'S"])
def test_word_ids_of_upper_case_contractions_beside_a_special_string(text):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY).encode([text.encode()])
    assert got[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["J\u030cx", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", "IT'S AJ\u030c J\u0327\u030cO E\u0301T\nDON'T"])
def test_word_ids_of_capitals_and_marks(text):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY).encode([text.encode()])
    assert got[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_word_ids_of_chunks_of_any_kind_equal_the_library():
    import random

    rng = random.Random(5)
    signs = "''''stmdrevlSTMDREVL  \n\"!<|>5\u00b2\u00bd\u00aa\u00b5\u00d7\u00df\u00f1\u00e9\u00c9\u012e\u012f\u0130\u212a\u212b\u0307\u0301\u030c\t\r\u00a0\u00ad\u0085\u65e5\u01c5\x7f\x1c.,;:a\U0001f600"
    texts = ["", " ", "  ", "\n", "'", "'s", "a' '", "re'x're'll 'r", "'s't''d"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    library = Tokenizer.from_file(word_ids.DEFAULT_VOCABULARY)
    encoder = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in encoder.encode([t.encode() for t in texts])] == [[*w, 1] for w in want]
    flat, ends = encoder.encode_flat([t.encode() for t in texts], None)
    assert flat.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert encoder.encode([]) == []


def test_word_ids_look_up_each_distinct_chunk_of_a_slice_once():
    class Counted(dict):
        looked_up = 0

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    encoder = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY)
    encoder.memo.now = Counted()
    one, many = encoder.encode([b"it is, it is"])[0], encoder.encode([b"it is, it is " * 500, b"is it"])[0]
    assert many.tolist() == one.tolist()[:-1] * 500 + [1]
    assert encoder.memo.now.looked_up < 20  # 7 distinct ones in two slices; one by one these are 2,007 chunks


def test_marks_that_capitals_compose_with_are_noticed():
    forms = [unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = {m for f in forms if "A" <= f[0] <= "Z" for m in f[1:]}
    hold = marks | {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFD", chr(c))[0] in marks}
    assert "\u030c" in marks and all(m.encode()[:1] in word_ids.MARKS for m in hold)


def test_small_memos_change_nothing(monkeypatch):
    encoder = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY)
    counts, pieces = token_counts.MergeTable(token_counts.DEFAULT_VOCABULARY), piece_codec.PieceModel(piece_codec.DEFAULT_MODEL)
    data = [t.encode() for t in TEXTS]
    whole = encoder.encode(data), counts.text_counts(TEXTS), pieces.encode_all(TEXTS)
    for memo in (encoder.memo, counts.memo, pieces.memo, pieces.parts):
        memo.limit, memo.now, memo.old = 5, {}, {}
    again = [encoder.encode([t])[0] for t in data], [counts.text_counts([t])[0] for t in TEXTS], [pieces.encode(t) for t in TEXTS]
    assert [x.tolist() for x in whole[0]] == [x.tolist() for x in again[0]] and whole[1:] == again[1:]


def test_packing(docs, empty, tmp_path):
    pieces = packing.pack(docs, longest=64).collect()
    assert all(p["length"] & (p["length"] - 1) == 0 and p["length"] <= 64 and p["length"] == 1 << p["bucket"] and p["offset"] == 0 for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    documents, open_ids = [], []
    for p in pieces:  # a document's pieces follow each other
        assert p["start"] == len(open_ids)
        open_ids += np.frombuffer(p["ids"], "<u4").tolist()
        if len(open_ids) == p["doc_tokens"]:
            documents.append((p["doc_id"], open_ids))
            open_ids = []
    assert sorted(map(str, documents)) == sorted(map(str, word_id_lists()))
    assert packing.pack(empty).count() == 0
    p = packing.digests(packing.pack(docs.where("doc_id = 1"))).first()
    ids = np.array(word_id_lists()[1][1][: p["length"]], "<u4")
    assert p["ids_crc32"] == zlib.crc32(ids.tobytes())
    packing.write_buckets(packing.pack(docs), f"file://{tmp_path}/b")
    assert packing.binary_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.pack(docs, longest=100)


PACKS_MANY_WORDS = """
import random, resource, pyarrow as pa
from tessera.llm import packing
rng = random.Random(1)
def batches(n, texts):
    for _ in range(n):
        words = [[rng.randbytes(4).hex() for _ in range(30_000)] for _ in range(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(texts)), pa.array([" ".join(w) for w in words])], ["id", "text"])
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
list(packing.cut(batches(1, 1), packing.DEFAULT_VOCABULARY, 2048, 1))
before = most()
assert sum(b.num_rows for b in packing.cut(batches(3, 32), packing.DEFAULT_VOCABULARY, 2048, 1)) > 128
print(most() - before)
"""


def test_packing_of_ever_new_words_takes_little_memory():
    took = subprocess.run([sys.executable, "-c", PACKS_MANY_WORDS], capture_output=True, text=True, check=True, timeout=300).stdout
    assert int(took) < 550  # MB; a worker that cuts 8 MB at once and remembers two times 500,000 words takes more


PACKS_BESIDE_AN_EXECUTOR = """
import random, resource, pyarrow as pa
from tessera.llm import packing
rng = random.Random(2)
def batches(n, texts):
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(range(texts)), pa.array([rng.randbytes(4 * 30_000).hex(" ", 4) for _ in range(texts)])], ["id", "text"])
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
list(packing.cut(batches(1, 1), packing.DEFAULT_VOCABULARY, 2048, 1))
before = most()
assert sum(b.column("length").to_numpy().sum() for b in packing.cut(batches(4, 32), packing.DEFAULT_VOCABULARY, 2048, 1)) > 4 * 32 * 30_000
print(most() - before)
"""


def test_packing_leaves_an_executor_its_memory():
    took = subprocess.run([sys.executable, "-c", PACKS_BESIDE_AN_EXECUTOR], capture_output=True, text=True, check=True, timeout=300).stdout
    assert int(took) < 300  # MB; two such workers and a JVM share an executor; one that cuts 4 MB at once and remembers two times 400,000 chunks takes over 500


def test_words_are_merged_as_the_library_merges_them():
    import random

    rng = random.Random(8)
    encoder = word_ids.WordEncoder(word_ids.DEFAULT_VOCABULARY)
    words = ["a" * n for n in range(1, 90)] + ["".join(rng.choice("aaelnstéüßñ") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    words += ["!" * n for n in range(1, 40)] + list("0123456789!?\"'") + ["'s", "'re", "$$$", "\u00a1", "\u012f"]
    library = Tokenizer.from_file(word_ids.DEFAULT_VOCABULARY)
    got = encoder.merges.encode([w.encode() for w in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert encoder.merges.encode([]) == []


def test_orc(spark, docs, empty, tmp_path, monkeypatch):
    for rows_per_file in (50_000, 3):
        monkeypatch.setattr(orc_ids, "ROWS_PER_FILE", rows_per_file)
        path = f"file://{tmp_path}/ids-{rows_per_file}"
        orc_ids.write_ids(docs, path)
        got = sorted((tuple(r) for r in orc_ids.id_checksums(spark, path).collect()), key=lambda r: r[1])
        assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
        ids = [r[0] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in word_id_lists()]
        assert sorted(str((i, n, crc)) for i, _, n, crc in got) == sorted(map(str, want))
        read = {(r["doc_id"], r["start"]): r["ids"] for r in orc_ids.read_ids(spark, path).collect()}
        assert {k: zlib.crc32(np.array(x, "<u4").tobytes()) for k, x in read.items()} == {(r[0], r[1]): r[3] for r in got}
    orc_ids.write_ids(empty, f"{path}-none")
    assert orc_ids.read_ids(spark, f"{path}-none").count() == 0


def test_orc_search_by_id_is_pushed_down(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    orc_ids.write_ids(docs, path)
    found = spark.read.schema(orc_ids.SCHEMA).orc(path).where(F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_orc_row_groups_are_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    orc_ids.write_ids(spark.range(6000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text").coalesce(1), path)

    def rows_read(where):
        """Rows that the scan hands on; a filter above it takes the ones that are wanted."""
        found = spark.read.schema(orc_ids.SCHEMA).orc(path).where(where)
        n = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, scan.metrics().apply("numOutputRows").value()

    assert rows_read("n_tokens > 0") == (6000, 6000)
    n, read = rows_read("doc_id between 100 and 110")  # by the row index's smallest and largest values
    assert n == 6 and read <= 2 * int(orc_ids.OPTIONS["orc.row.index.stride"])
    assert rows_read("doc_id = 4001")[1] == 0 or rows_read("doc_id = 4003")[1] == 0  # inside the values' range: by the Bloom filters
