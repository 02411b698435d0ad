"""Language ID, toxicity, fingerprints, mixing: held-out accuracy, brute force, odd input."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, mixing, sketch, toxicity

SF = "/root/testdata/sf0.01"
LONG = "word " * 30_000


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def table(spark, name):
    return spark.read.parquet(os.path.join(SF, f"{name}.parquet"))


def test_langid_held_out_accuracy(spark):
    d = table(spark, "documents")
    model = langid.fit(d.filter(~langid.held_out()))
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_langid_odd_rows(spark):
    d = docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 !? \t", "de", "a"), (4, "der die das", "de", "a"), (5, "the and of", "en", "a"),
                     (6, LONG, None, None), (None, "der die", "de", "a"), (5, "İstanbul the", "en", "a")]).withColumn("score", F.lit("x"))
    model = langid.fit(d)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(d, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en")} <= got
    assert all(0 <= r.score <= 1 for r in langid.predict(d, model).collect())
    assert langid.predict(d.limit(0), model).count() == 0
    none = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"}
    assert langid.annotate(d, model).columns == [*d.columns, "__lang_pred", "__lang_score"]


def test_toxicity_learns_from_document_labels(spark):
    rng = np.random.default_rng(0)
    words = ["apple", "river", "stone", "cloud", "maple", "quiet", "garden", "window"]
    rows, labels = [], []
    for k in range(400):
        s = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if k % 4 == 0:
            s[int(rng.integers(5))] += " scoundrel"
        rows.append((k, ". ".join(s) + ".", None, None))
        labels.append((k, int(k % 4 == 0)))
    lab = spark.createDataFrame([*labels, labels[0], (None, 1), (3, None)], "doc_id bigint, toxic int")
    d = docs(spark, [*rows, (1000, None, None, None), (1001, "", None, None), (1002, LONG, None, None)])
    model = toxicity.fit(d, lab.filter("doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(300, 400))
    assert got[1000].score == got[1001].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    found = toxicity.offending(d.filter("doc_id >= 300 and doc_id < 400"), model).collect()
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in found} == {k for k in range(300, 400) if k % 4 == 0}
    assert all("scoundrel" in text[r.doc_id][r.start:r.stop] for r in found)


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a b", None, None)])
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [tuple(r) for r in toxicity.score(d, model).collect()] == [(1, 0.0, 0)]
    assert toxicity.offending(d, model).count() == 0


# ---------------------------------------------------------------- fingerprints

def test_edits_follow_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", 7)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(50)]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 40)))) + "é", None, None) for i in rng.permutation(60) * 3]
    rows += [(500, None, None, None), (501, "", None, None), (502, LONG, None, None), (6, "zz tie", None, None), (None, "last one", None, None)]
    df = docs(spark, rows).withColumns({"id": F.lit(1), "part": F.lit("p")})
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in sketch.with_edits(df).collect()), key=str)
    order = sorted(((1 << 63) - 1 if r[0] is None else r[0], r[1] or "", r[0]) for r in rows)
    want = []
    for k, (_, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sketch.with_edits(df.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:4000]), np.unique(pool[2000:])
    sa, sb = a[:sketch.K], b[:sketch.K]
    assert abs(sketch.resemblance(sa, sb) - 1 / 3) < 0.12
    assert abs(sketch.containment(sa, sb) - 1 / 2) < 0.2
    assert abs(sketch.distinct_count(sa) / 4000 - 1) < 0.3
    assert np.array_equal(sketch.merge(sa, sb), np.union1d(a, b)[:sketch.K])
    assert np.array_equal(sketch.decode(sketch.encode(sa)), sa)
    none = np.zeros(0, np.uint64)
    assert sketch.resemblance(none, none) == 1.0 and sketch.resemblance(none, sa) == 0.0


def test_merged_sketches(spark):
    d = docs(spark, [(k, " ".join(f"t{(k * 7 + j) % 90}" for j in range(60)), "en", "ab"[k % 2]) for k in range(30)])
    s = sketch.sketches(d).join(d.select("doc_id", "source"), "doc_id")
    got = {r.source: r.sketch for r in sketch.merged(s, "source").collect()}
    for c in "ab":
        every = np.unique(np.concatenate([r.sketch for r in s.filter(F.col("source") == c).collect()]))
        assert got[c] == every[:sketch.K].tolist()


# ---------------------------------------------------------------- mixing

def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(mixing.oracle() + " ORDER BY doc_id").fetchall()
    got = mixing.sampling_report(table(spark, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6), "keep").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_mixing_fits_given_targets(spark):
    pooled = spark.createDataFrame([(f"={s}", f"={lang}", "=prose", int(n)) for s, lang, n in (("a", "en", 90), ("a", "de", 30), ("b", "en", 40), ("b", "de", 7))],
                                   "g_source string, g_lang string, g_topic string, n bigint")
    got = mixing.rake(pooled, {"source": {"a": 1, "b": 3}, "lang": {"en": 0.5, "de": 0.5}}, rounds=40).collect()
    assert sum(r.w for r in got) == pytest.approx(1)
    assert sum(r.w for r in got if r.g_source == "=b") == pytest.approx(0.75, abs=1e-6)
    assert sum(r.w for r in got if r.g_lang == "=de") == pytest.approx(0.5, abs=1e-6)


def test_mixing_gives_every_source_its_own_target(spark):
    words = {f"s{k:03}": 20 + k % 7 for k in range(300)}
    d = docs(spark, [(2 * k + i, "w " * (n + 3 * i), lang, s) for k, (s, n) in enumerate(words.items()) for i, lang in enumerate(("de", "en"))])
    n = np.array([[w, w + 3] for w in words.values()], float)
    goals = [(m := n.sum(axis=a) ** mixing.ALPHA) / m.sum() for a in (1, 0)]
    w = n / n.sum()
    for _ in range(mixing.ROUNDS):
        w *= (goals[0] / w.sum(axis=1))[:, None]
        w *= goals[1] / w.sum(axis=0)
    got = {(r.source, r.lang): r.prob for r in mixing.probabilities(d).collect()}
    assert len(got) == 600
    for k, s in enumerate(words):
        for i, lang in enumerate(("de", "en")):
            assert got[s, lang] == pytest.approx(min(1, mixing.BUDGET * n.sum() * w[k, i] / n[k, i]))


def test_mixing_odd_rows(spark):
    d = docs(spark, [(1, None, "en", "a"), (2, "", None, None), (3, "x y z", None, "a"), (3, "x y z", None, "a"), (None, "q r", "en", None), (4, LONG, "en", "a")]).withColumn("prob", F.lit("p"))
    r = {x.doc_id: x for x in mixing.sampling_report(d).collect()}
    assert r[1].prob == r[2].prob == 0 and r[1].n_tokens == 0 and r[3].lang == "(null)" and r[4].n_tokens == 30_000
    kept = mixing.sample(d, budget=10.0)
    assert kept.columns == d.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["3", "3", "4", "None"]
    assert mixing.sampling_report(d.limit(0)).count() == 0


def test_mixing_runs_no_python(spark):
    plan = mixing.sampling_report(table(spark, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
