"""WARC, BPE, ANN and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, forest, langid, queries, warc

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- WARC

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (7, "http://b", "same"), (3, None, "same"), (4, "http://c", None), (9, "u", ""), (5, "http://d\r\nx", "é" * 50_000), (6, "u", "one"), (6, "u", "one"), (None, "n", "same")]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows).withColumn("size", F.lit(0))).collect()}
    d = lambda t: warc.sha1_32(t.encode())
    assert got == {(1, 4, d("same"), "revisit", 7), (7, 4, d("same"), "response", None), (3, 4, d("same"), "revisit", 7), (None, 4, d("same"), "revisit", 7), (4, 0, d(""), "revisit", 9),
                   (9, 0, d(""), "response", None), (5, 100_000, d("é" * 50_000), "response", None), (6, 3, d("one"), "response", None)}
    assert warc.round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    whole = [warc.record(k, "u", f"payload {k} ".encode() * 40) for k in range(6)]
    parts = [gzip.compress(r, mtime=0) for r in whole] if packed else whole
    data = bytearray(b"".join(parts))
    hurt = sum(map(len, parts[:2])) + len(parts[2]) // 2
    data[hurt:hurt + 8] = b"\xff" * 8
    data = bytes(data) + b"tail"
    found = list(warc.salvage(data))
    assert [warc.page_of(x[2]["WARC-Record-ID"]) for x in found if x[0] == "record"] == [0, 1, 3, 4, 5]
    gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
    start = sum(map(len, parts[:2]))
    assert gaps == [(start, start + len(parts[2])), (len(data) - 4, len(data))]
    assert list(warc.salvage(b"")) == []


def ids(found):
    return [warc.page_of(x[2]["WARC-Record-ID"]) for x in found if x[0] == "record"]


def test_salvage_inside_a_member():
    """Several records in one member: a bad one goes alone, and damage to the member spares the records before it."""
    whole = [warc.record(k, "u", random.Random(k).randbytes(9_000)) for k in range(6)]
    hurt = [*whole[:2], whole[2].replace(b"sha1:", b"sha1:X", 2), b"stray", *whole[3:]]
    member, after = gzip.compress(b"".join(hurt), mtime=0), gzip.compress(warc.record(9, "u", b"x"), mtime=0)
    found = list(warc.salvage(member + after))
    assert ids(found) == [0, 1, 3, 4, 5, 9]
    size = sum(map(len, whole[:2]))
    assert [x[1:] for x in found if x[0] == "gap"] == [(0, len(member), f"bad block digest in bytes {size}-{size + len(hurt[2]) + 5} of the member")]
    member = bytearray(gzip.compress(b"".join(whole), mtime=0))
    for data, gap in ((bytes(member[:-20]) + after, len(member) - 20), (bytes(member[:30_000]), 30_000)):
        found = list(warc.salvage(data))
        assert ids(found)[:3] == [0, 1, 2] and (len(data) <= 30_000 or ids(found)[-1] == 9)
        assert [x[1:3] for x in found if x[0] == "gap"] == [(0, gap)]


def test_read_reports_gaps(spark):
    good = gzip.compress(warc.record(1, "u", b"x"), mtime=0)
    df = spark.createDataFrame([("a", bytearray(b"junk" + good)), ("b", None)], "archive string, data binary")
    got = warc.read(df).orderBy("offset").collect()
    assert [(r.kind, r.offset, r.stop, r.page_id, r.payload_ok) for r in got] == [("gap", 0, 4, None, None), ("record", 4, None, 1, True)]


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def bpe_texts():
    rnd = random.Random(1)
    out = ["", " \n", "I'm Σίσυφος ΣΣ İstanbul é \x1c\x85 a\x1fb 123 <|endoftext|>x it's", "the" * 300 + "x" + "a" * 900, "aaaab" * 200, "".join(chr(97 + i * i % 26) for i in range(3000)), "中文 🎉🎉👍🏽 ﬁ", "don't we'll 'S"]
    for _ in range(400):
        out.append("".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(97, 123), rnd.randrange(0, 0x250), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(rnd.randrange(40))))
        out.append("".join(rnd.choice("etaoinshrdl") for _ in range(rnd.randrange(80))))
    return out


def test_bpe_equals_library(library):
    enc, dec = bpe.Encoder(queries.tokenizer_path()), bpe.Decoder(queries.tokenizer_path())
    for t in bpe_texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = enc.encode(t)
        assert got.tolist() == want, t
        assert dec.feed(got) + dec.finish() == library.decode(want, skip_special_tokens=False)


def test_transducer_holds_bounded_symbols():
    m = bpe.Encoder(queries.tokenizer_path()).machine
    rnd = random.Random(3)
    most, text = 0, "".join(rnd.choice("etaoinshrdlu") for _ in range(20_000))
    out = []
    for k in range(0, len(text), 50):
        out += m.feed(text[k:k + 50])
        most = max(most, len(m.pending))
    out += m.finish()
    assert most <= 8 * m.longest
    assert out[:200] == m.plain(text[:3000])[:200]


def test_decoder_state_machine():
    enc, dec = bpe.Encoder(queries.tokenizer_path()), bpe.Decoder(queries.tokenizer_path(), library=False)
    ids = enc.encode("naïve 🎉 word")
    assert "".join(dec.feed([i]) for i in ids.tolist()) + dec.finish() == "naïve 🎉 word "


def test_bpe_query_equals_library(spark, library):
    got = {r.doc_id: r for r in queries.op7_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 30_000), (3, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = sorted((str(r.doc_id), r.n_tokens) for r in bpe.round_trip(df, queries.tokenizer_path()).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 30_000), ("None", 1)]
    assert bpe.encode(df.limit(0), queries.tokenizer_path()).count() == 0


# ---------------------------------------------------------------- ANN

def test_ann_recall_and_scores(spark):
    got = forest.search(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    at = {i: k for k, i in enumerate(ids.tolist())}
    hit = n = 0
    for q in ids[ids % 20 == 0].tolist():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        s = x @ x[at[q]]
        want = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        hit, n = hit + len(set(want) & {m[1] for m in mine}), n + 20
        assert np.allclose([m[2] for m in mine], [s[at[m[1]]] for m in mine])
    assert hit / n >= 0.9


def test_ann_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD_ROWS", 700)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = forest.search(df).collect()
    hit = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 2000 >= 0.9


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"v": F.lit(1), "rank": F.lit(2)})
    got = sorted(tuple(r) for r in forest.search(df).collect())
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 6, 1.0), (0, 4, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 5, 1.0), (20, 3, 6, 1.0), (20, 4, 6, 1.0)]
    assert forest.search(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5), (10_004, "the and of word " * 20, None, "s", 320)], d.schema)
    rows, sizes = d.unionAll(odd), []
    for name, stage in p.STAGES:
        out = stage(spark, rows, SF)
        if name != p.STAGES[-1][0]:
            assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
            rows = spark.createDataFrame(out.collect(), d.schema)
            sizes.append(rows.count())
            if name == "language_id":
                ids = {r.doc_id: r.lang for r in rows.collect()}
                assert not {10_001, 10_002, 10_003} & set(ids) and ids[10_004] is not None
                assert len(ids) == 201
    assert sizes == sorted(sizes, reverse=True) and out.count() == sizes[-1]
    assert p.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for _name, stage in p.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language_id", "op2_suffix_dedup", "op3_simhash", "op4_fingerprints", "op8_toxicity", "op9_substring_dedup"):
        got = queries.QUERIES[name][0](spark, SF)
        assert got.count() == n and got.select("doc_id").distinct().count() == n
    held = queries.op1_language_id(spark, SF).select("doc_id", "held_out").collect()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert langid.UND == "und"
