"""Importance resampling, embedding near-duplicates, token alignment: brute force, the libraries themselves, odd input."""

import hashlib
import math
import os
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskloom.llm import align, codes, queries, resample

SF = "/root/testdata/sf0.01"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ---------------------------------------------------------------- importance resampling

def resampled(texts, target, max_words=1, buckets=97, percent=10, least=3):
    """Plain Python: {row: (n_features, weight, score, rank)} for (doc_id, text) rows."""
    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]
    raw = [grams(t) for _, t in texts]
    s, t = Counter(b for _, g in raw for b in g), Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for k, ((i, _), (n, g)) in enumerate(zip(texts, raw, strict=True)):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in g)
        out.append([k, i, n, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[5], math.inf if x[1] is None else x[1]))
    place = {x[0]: r + 1 for r, x in enumerate(able[:len(able) * percent // 100])}
    return [(x[1], x[3], x[4], x[5], place.get(x[0])) for x in out]


ODD = [(1, None), (2, ""), (3, "One two ONE  two-three"), (4, "Zwölf Boxkämpfer, 12 — naïve ﬁn\x00end"), (4, "other text under the same id"), (None, "no id at all here"),
       (5, "x" * 70 + " " + "ab " * 200), (6, "word\n" * 100_000), (7, "q" * 600_000 + " tail"), (8, "One two ONE  two-three"), (9, "!!! ... ---")]


@pytest.mark.parametrize("max_words,percent", [(1, 10), (3, 50), (2, 100), (1, 0)])
def test_resampling_against_plain_python(spark, max_words, percent):
    rows = ODD + [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 31))) for k in range(100, 300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1)}).repartition(5)
    target = spark.createDataFrame([("One two w3 w5",), (None,), ("w7 Zwölf",)], "text string")
    got = resample.resample(d, target, max_words, 97, percent, 3)
    want = resampled(rows, ["One two w3 w5", None, "w7 Zwölf"], max_words, 97, percent, 3)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_resampling_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d")] * 20, "doc_id bigint, text string")
    none = d.select("text").limit(0)
    assert sorted(r["rank"] or 99 for r in resample.resample(d, none, percent=25, min_words=4).collect()) == [1, 2, 3, 4, 5] + [99] * 15
    assert resample.resample(d.limit(0), none).collect() == []
    assert [r["rank"] for r in resample.resample(d.limit(3), d.select("text"), min_words=5).collect()] == [None] * 3


def test_resampling_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = {tuple(r) for r in queries.op11_resampling(spark, SF).collect()}
    assert got == set(duckdb.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries._SQL11})").fetchall())


# ---------------------------------------------------------------- embedding near-duplicates

def linked(ids, x, threshold=0.95):
    """Plain NumPy: per row (n_links, component)."""
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    on = u @ u.T >= threshold
    np.fill_diagonal(on, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(on, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return on.sum(axis=1), low
        low = new


def clusters(n, dim, seed, groups=40, spread=(0.02, 0.33)):
    """Vectors of which half lie in groups at various distances from their centre, many right around the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    centre = rng.standard_normal((groups, dim))
    for k in range(n // 2):
        c = centre[k % groups] / np.linalg.norm(centre[k % groups])
        e = rng.standard_normal(dim)
        x[k] = (c + rng.uniform(*spread) * e / np.linalg.norm(e)) * rng.uniform(0.1, 9)
    return x


def pairs_of(x, threshold=0.95):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return int((np.triu(u @ u.T >= threshold, 1)).sum())


@pytest.mark.parametrize("small", [False, True])
def test_embedding_links_against_numpy(spark, monkeypatch, small):
    if small:                                            # many cells, several blocks and tiles
        for name, value in (("CELL_ROWS", 64), ("BLOCK_ROWS", 50), ("TILE", 16), ("MAX_HOT", 3)):
            monkeypatch.setattr(codes, name, value)
    x = clusters(1500, 24, 1)
    x[700:720] = x[0]                                    # equal vectors
    x[720] = 3 * x[0]
    d = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in codes.near_duplicates(d.repartition(6)).collect()}
    n, low = linked(list(range(len(x))), x)
    found, there = sum(r.n_links for r in got.values()), int(n.sum())
    assert len(got) == len(x) and all(got[k].n_links <= n[k] for k in got)
    assert found == there if not small else found >= 0.998 * there
    if not small:
        assert [got[k].component_id for k in range(len(x))] == low.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_codes_are_unbiased_and_bounded():
    x = codes.unit(clusters(2000, 64, 3))
    c = codes.Codes(codes.encode(x), 64)
    true = x @ x.T
    estimate = (c.signs @ c.q.T) / c.f[:, None]
    off = ~np.eye(len(x), dtype=bool)
    assert abs((estimate - true)[off].mean()) < 1e-3
    assert (codes.undecided(c, c, 0.95) | (true < 0.95)).all()          # no link is ruled out
    assert codes.undecided(c, c, 0.95).sum() < 3 * (true >= 0.95).sum()  # and little else is left
    assert (c.upper(c) >= true)[off].mean() > 0.93


def test_embedding_tables_follow_the_chance_of_a_shared_cell():
    for n in (10_000, 60_000, 2_000_000, 10 ** 9):
        width, digits, tables = codes.plan(n)
        cells = (2 * width) ** digits
        assert n / codes.CELL_ROWS <= cells <= 40 * n / codes.CELL_ROWS and tables < 120
    x = codes.unit(clusters(4000, 64, 5, groups=200, spread=(0.2, 0.25)))
    hit = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    cells = codes.cell_numbers(x, *codes.plan(200_000))
    assert (cells[hit[:, 0]] == cells[hit[:, 1]]).any(axis=1).mean() > 0.995


def test_embedding_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(10, v), (11, [2.0, 4.0, 6.0]), (12, None), (13, [0.0] * 3), (14, [1.0, None, 3.0]), (15, [nan, 2.0, 3.0]), (16, [inf, 2.0, 3.0]), (17, []), (18, v[:2]),
            (19, [1.0, 2.1]), (10, v), (9, [-1.0, -2.0, -3.0]), (None, v), (None, [5.0, -5.0, 1.0]), (20, [1e300, 2e300, 3e300]), (20, [3.0, -1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"kept": F.lit("x"), "node": F.lit(1)})
    got = Counter(tuple(r) for r in codes.near_duplicates(d).collect())
    assert got == Counter([(10, 4, 10, True), (10, 4, 10, True), (11, 4, 10, False), (None, 4, 10, False), (20, 4, 10, False), (20, 0, 20, True), (None, 0, None, False),
                           (18, 1, 18, True), (19, 1, 18, False), (9, 0, 9, True), *((k, 0, k, True) for k in (12, 13, 14, 15, 16, 17))])
    assert codes.near_duplicates(d.limit(0)).collect() == []
    assert {tuple(r) for r in codes.near_duplicates(d.filter("vec_id in (12, 13)")).collect()} == {(12, 0, 12, True), (13, 0, 13, True)}


def test_embedding_query_against_numpy(spark):
    sf = "/root/testdata/check_s" if os.path.exists("/root/testdata/check_s") else SF
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.vec_id: r for r in queries.op12_embedding_dedup(spark, sf).collect()}
    x = np.array([r.embedding for r in rows], float)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    there = sum(int((u[a:a + 1000] @ u.T >= 0.95).sum()) for a in range(0, len(u), 1000)) - len(u)
    assert len(got) == len(rows) and 0.999 * there <= sum(r.n_links for r in got.values()) <= there


# ---------------------------------------------------------------- token alignment

def aligned(texts):
    """Plain Python with the libraries' whole-text encodings."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    docs, pairs = [], Counter()
    for text in texts:
        ids_a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = tb.encode(text) if text else []
        by_a = [bytes(letters[c] for c in ta.id_to_token(k)) for k in ids_a]
        by_b = [bytes([int(tb.id_to_piece(k)[3:-1], 16)]) if tb.is_byte(k) else tb.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(by_a) != want or b"".join(by_b) != want:
            docs.append(([], [], []))
            continue
        end_a = {e: k for k, e in enumerate(np.cumsum([len(x) for x in by_a]).tolist())}
        end_b = {e: k for k, e in enumerate(np.cumsum([len(x) for x in by_b]).tolist())}
        links = [(end_a[e], end_b[e]) for e in sorted(end_a.keys() & end_b.keys())]
        pairs.update((ids_a[i], ids_b[j]) for i, j in links)
        docs.append((ids_a, ids_b, links))
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for ids_a, ids_b, links in docs:
        i = j = 0
        groups = []
        for p, q in links:
            groups.append(",".join(map(str, ids_a[i:p + 1])) + "|" + ",".join(map(str, ids_b[j:q + 1])))
            i, j = p + 1, q + 1
        ids = [(ids_a[p], ids_b[q]) for p, q in links]
        out.append((len(ids_a), len(ids_b), len(links), len(links), sum(pairs[x] == most[x[1]] for x in ids), sum(pairs[x] for x in ids),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


HARD = [None, "", " ", "  ", "a ", " a", "a  b   c\n\n d\t\te  ", "Don't we'll I'D 's'", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under ▁▁", "naïve café Ὀδυσσεύς",
        "日本語のテキスト、漢字", "🙂🏽‍♀️ emoji‍", "\x00\x01\x1c\x1d\x85\xa0x y　z", "ﬁ ﬂ Ⅷ ½ ²", "é combining", "x" * 3000, "1234567 12,345.678", "\r\n\r\n", "𝔘𝔫𝔦 ꙮ ᏣᎳᎩ",
        "word " * 20_000, "ab" * 5000 + " " * 500 + "end"]


def test_alignment_against_the_libraries(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    texts = HARD + docs + docs[:3]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_a": F.lit("x"), "block": F.lit(0)})
    got = align.token_alignment(d.repartition(4), A, B).collect()
    want = [(i, *x) for (i, _), x in zip(rows, aligned(texts), strict=True)]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert align.token_alignment(d.limit(0), A, B).collect() == []


def test_alignment_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_LINKS", 50)
    monkeypatch.setattr(align, "PIECE", 400)
    texts = [f"the cat number {k % 5} sat on mat {k}" for k in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = align.blocks(d, A, B)
    assert rows.count() > 10
    got = sorted(tuple(r) for r in align.token_alignment(d, A, B).collect())
    assert got == [(k, *x) for k, x in enumerate(aligned(texts))]


def test_parts_are_encoded_as_the_whole_text():
    """Every code point that the parts' path takes, in several surroundings; and B's parts."""
    steady = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and align._STEADY.fullmatch(chr(c))]
    assert all(unicodedata.category(c) != "Cn" for c in steady)
    few = [c for c in steady if c < "ༀ"] + steady[::37]
    texts = [f"a{c}b {c}{c} 1{c}x  {c}\n {c}'s{c}\n\n  {c} x" for c in few]
    t, m = align._side_a(A)[0], align._side_b(B)[0]
    for k in range(0, len(texts), 2000):
        part = texts[k:k + 2000]
        ids_a, ids_b = align.tokens(A, B, part)
        assert [x.tolist() for x in ids_a] == [x.ids for x in t.encode_batch([" " + x for x in part], add_special_tokens=False)]
        assert [x.tolist() for x in ids_b] == m.encode(part)


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(0)
    size = lambda n: np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, n), n // 3, replace=False)), [n]]))
    import pandas as pd

    def table(cuts):
        parts = [pd.DataFrame({"doc": k, "end": np.cumsum(c) + 100 * k, "start": np.cumsum(c) - c + 100 * k}) for k, c in enumerate(cuts)]
        return pd.concat(parts, ignore_index=True).assign(at=lambda x: np.arange(len(x)))

    a, b = table([size(60) for _ in range(4)]), table([size(60) for _ in range(4)])
    got = {tuple(x) for x in align.overlaps(a, b).tolist()}
    want = {(i, j) for i in range(len(a)) for j in range(len(b))
            if a.doc[i] == b.doc[j] and max(a.start[i], b.start[j]) < min(a.end[i], b.end[j])}
    assert got == want and len(align.overlaps(a, b)) == len(want)


# ---------------------------------------------------------------- language ID, toxicity, neighbours: what earlier limits left out

def brute_bayes(train, texts):
    """Plain Python naive Bayes over the operator's own n-gram hashes."""
    from riskloom.llm import langid

    def grams(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return langid._grams(raw, np.array([0, len(raw)]))[0].tolist()
    counts, docs = {}, Counter()
    for t, lang in train:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(t))
    out = []
    for t in texts:
        g = grams(t)
        logs = {x: math.log(docs[x] / len(train)) + sum(math.log((c[b] + 1) / (sum(c.values()) + langid.BUCKETS)) for b in g) for x, c in counts.items()}
        top = max(sorted(logs), key=logs.get)
        out.append((top, 1 / sum(math.exp(v - logs[top]) for v in logs.values())))
    return out


def test_language_id_of_600_languages_against_plain_python(spark, monkeypatch):
    from riskloom.llm import langid

    rng = np.random.default_rng(8)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(4)] for k in range(600)}
    rows = [(k, " ".join(words[k]), f"l{k:03d}") for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(d)
    assert len(model["langs"]) == 600 and [x.shape[1] for x in model["logp"]] == [64] * 9 + [24]
    ask = [" ".join(words[k][:3]) for k in range(0, 600, 40)] + ["zzzz", "a"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string"), model).collect()}
    for k, (lang, p) in enumerate(brute_bayes([(t, x) for _, t, x in rows], ask)):
        assert got[k].lang_pred == lang and got[k].score == pytest.approx(p, rel=1e-9)


def test_only_letters_have_a_language(spark):
    from riskloom.llm import langid

    d = spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de")], "doc_id bigint, text string, lang string")
    model = langid.fit(d)
    ask = ["½ ² 12", "Ⅷ", "_ 3", "ª", "и", "中"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string"), model).collect()}
    assert [got[k].lang_pred == "und" for k in range(6)] == [True, True, True, False, False, False] and all(got[k].score == 0 for k in range(3))


def test_toxicity_trains_on_long_texts_and_finds_the_sentence(spark):
    from riskloom.llm import toxicity

    clean = "The apple river stone cloud maple garden. " * 320
    rows = [(k, clean + ("You scoundrel of the first order. " if k % 2 else "") + clean) for k in range(60)]
    d = spark.createDataFrame([*rows, (1, rows[1][1]), (2, "another text of id 2")], "doc_id bigint, text string").withColumns({"offending": F.lit(0), "toxic": F.lit(9)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, labels)
    got = toxicity.score_and_locate(d.filter("doc_id > 2"), model).collect()
    assert len(rows[0][1]) > 20_000 and all(r.predicted == r.doc_id % 2 for r in got)
    for r in got:
        raw = rows[r.doc_id][1].encode()
        assert [b"scoundrel" in raw[x.start:x.stop] for x in r.offending] == [True] * (r.doc_id % 2)
    # noisy-or of the sentences, by hand
    text = "You scoundrel here. Apple garden of stone! A cloud"
    one = toxicity.score_and_locate(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model, threshold=0.0).first()
    assert len(one.offending) == 3 and one.score == pytest.approx(1 - math.prod(1 - x.score for x in one.offending), rel=1e-9)
    assert toxicity.score(d.limit(0), model).collect() == []


def test_toxicity_sample_is_bounded_by_text(spark, monkeypatch):
    from riskloom.llm import toxicity

    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3_000)
    monkeypatch.setattr(toxicity, "MIN_DOCS", 1)
    rows = [(k, ("good words here. " if k % 2 else "bad words there. ") * 30) for k in range(100)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k, 1 - k % 2) for k in range(100)], "doc_id bigint, toxic int"))
    assert model["w"] is not None and model["mean"] == 0.5


def test_neighbours_of_rows_that_repeat_an_id(spark):
    from riskloom.llm import forest

    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    rows = [(20, x[0].tolist()), (20, x[1].tolist())] + [(100 + 2 * k + 1, v.tolist()) for k, v in enumerate(x[2:])]
    got = forest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert Counter(r.query_id for r in got) == {20: 40} and Counter(r["rank"] for r in got) == dict.fromkeys(range(1, 21), 2)
    for q, other in ((0, 1), (1, 0)):
        s = sorted(((-float(x[k] @ x[q]), i) for k, (i, _) in enumerate(rows) if k != q))[:20]
        want = Counter((i, round(-d, 9)) for d, i in s)
        assert not want - Counter((r.vec_id, round(r.score, 9)) for r in got)


# ---------------------------------------------------------------- WARC salvage

def test_salvage_of_a_damaged_member_behind_another():
    import gzip
    import random

    from riskloom.llm import warc

    whole = [warc.record(k, "u", random.Random(k).randbytes(20_000)) for k in range(5)]
    bad = bytearray(gzip.compress(whole[0], mtime=0))
    bad[len(bad) // 2:len(bad) // 2 + 9] = b"\xff" * 9
    cut = gzip.compress(b"".join(whole[1:4]), mtime=0)[:50_000]
    last = gzip.compress(whole[4], mtime=0)
    for tail, want in ((b"", [1, 2]), (last, [1, 2, 4])):
        found = list(warc.salvage(bytes(bad) + cut + tail))
        assert [warc.page_of(x[2]["WARC-Record-ID"]) for x in found if x[0] == "record"] == want
        gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
        assert gaps[0] == (0, len(bad)) and gaps[1] == (len(bad), len(bad) + len(cut))


def test_records_of_other_writers():
    import base64

    from riskloom.llm import warc

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    for digest in (None, "sha256:" + hashlib.sha256(block).hexdigest(), "SHA1:" + hashlib.sha1(block).hexdigest().upper(), "sha-256:" + base64.b64encode(hashlib.sha256(block).digest()).decode(),
                   "blake9:abc", "md5:" + base64.b32encode(hashlib.md5(block).digest()).decode()):
        head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-Id:  <urn:page:8>\r\ncontent-length:{len(block)}\r\n" + (f"warc-block-digest: {digest}\r\n" if digest else "")
        got = list(warc.salvage(head.encode() + b"\r\n" + block + b"\r\n\r\n"))
        assert [x[0] for x in got] == ["record"] and got[0][2]["WARC-Record-ID"] == "<urn:page:8>" and got[0][3] == block
    wrong = f"WARC/1.0\r\nContent-Length: {len(block)}\r\nWARC-Block-Digest: sha256:00\r\n\r\n".encode() + block + b"\r\n\r\n"
    assert [x[0] for x in warc.salvage(wrong)] == ["gap"]


# ---------------------------------------------------------------- mixing

def test_mixing_of_300_sources_equals_sql(spark, tmp_path):
    from riskloom.llm import mixing

    rng = np.random.default_rng(6)
    rows = [(k, "word " * int(rng.integers(1, 40)), ["en", "de"][k % 2], f"s{int(rng.zipf(1.3)) % 300 if k > 300 else k}") for k in range(900)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_tokens, r.prob) for r in mixing.sampling_report(d).select("doc_id", "n_tokens", F.round("prob", 6).alias("prob")).collect()}
    duckdb.execute(f"CREATE OR REPLACE VIEW mixed AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = {r[0]: r[1:] for r in duckdb.execute(f"SELECT doc_id, n_tokens, prob FROM ({mixing.oracle(table='mixed')})").fetchall()}
    assert len({r[3] for r in rows}) == 301 or len({r[3] for r in rows}) == 300
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in got)
