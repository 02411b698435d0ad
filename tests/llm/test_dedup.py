"""SimHash, suffix arrays, line dedup: against brute force, with nulls, empty and long texts, ties and empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import common, simhash, substrings, suffixes

LONG = "word " * 30_000


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def tricky(seed=3, n=80):
    rnd = random.Random(seed)
    lore = "".join(rnd.choice("abcdefgh é") for _ in range(4000))
    rows = [(None, lore[:300]), (5, None), (6, ""), (7, "a" * 400), (3, "a" * 120), (3, "a" * 120), (9, "\0" * 100), (10, "\0" * 60 + "x"),
            (11, lore[100:400]), (11, lore[150:600]), (12, LONG), (13, LONG)]
    for _ in range(n):
        rows.append((rnd.randrange(1000), "".join(lore[(a := rnd.randrange(3500)):a + rnd.randrange(200)] for _ in range(rnd.randrange(6)))))
    return rows


# ---------------------------------------------------------------- suffix arrays

def brute_suffixes(rows, length=50):
    first = {}
    for i, t in rows:
        b, d = (t or "").encode(), 1 << 62 if i is None else i
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(d, first.get(b[k:k + length], 1 << 63))
    out = []
    for i, t in rows:
        b, d = (t or "").encode(), 1 << 62 if i is None else i
        m = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < d:
                m[k:k + length] = True
        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
        out.append((i, len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "shards", "ranges"), [(2000, None, None), (3, 20, 7)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, shards, ranges):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = tricky()
    df = docs(spark, rows).withColumns({"id": F.lit("x"), "shard": F.lit(1)})        # extra columns with clashing names
    got = sorted([tuple(r) for r in suffixes.dedup_report(df, shards=shards, ranges=ranges).collect()], key=str)
    assert got == brute_suffixes(rows)


def test_suffix_dedup_one_id_on_many_texts(spark):
    """A third of the rows have no id and a third one id: they part over shards, and never remove each other's bytes."""
    rnd = random.Random(5)
    lore = "".join(rnd.choice("abcdefgh") for _ in range(2000))
    rows = [((None, 4, k)[k % 3], lore[(a := rnd.randrange(1500)):a + rnd.randrange(300)] + str(k)) for k in range(90)]
    df = docs(spark, rows)
    assert sorted([tuple(r) for r in suffixes.dedup_report(df, shards=9, ranges=5).collect()], key=str) == brute_suffixes(rows)
    by_shard = suffixes._run(df, 50, 9, 5)[0].applyInArrow(lambda t: t.slice(0, 1).select(["shard"]), "shard int")
    assert by_shard.count() > 5


def test_suffix_spans_and_empty_table(spark):
    assert suffixes.dedup_report(docs(spark, [])).count() == 0
    text = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    got = suffixes.removed_spans(docs(spark, [(1, text), (2, "zz" + text + "yy")])).collect()
    assert [tuple(r) for r in got] == [(2, 2, 2 + len(text))]


def test_suffix_array_order():
    rnd = random.Random(1)
    texts = list({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 90))).encode() for _ in range(200)})
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    order, _ = suffixes.suffix_array(data, left)
    got = [data[i:i + left[i]].tobytes() for i in order]
    assert got == sorted(got)
    lcp = suffixes.common_prefixes(data, left, starts, order, 5)
    for k in range(1, len(got)):
        if len(got[k]) >= 5:
            want = next((j for j in range(min(5, len(got[k]), len(got[k - 1]))) if got[k][j] != got[k - 1][j]), min(5, len(got[k - 1])))
            assert lcp[k] == want


def test_suffix_last_window_before_shorter_suffixes(spark):
    """The greatest repeated window is followed by shorter suffixes only ("zz" after "zy..."): it is a repeat all the same."""
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefgh") for _ in range(48))
    rows = [(k, x + "zy" + body + "zz") for k, x in enumerate(("aa", "bb", "cc"))]
    got = sorted([tuple(r) for r in suffixes.dedup_report(docs(spark, rows)).collect()], key=str)
    assert got == brute_suffixes(rows)
    for _ in range(60):
        texts = ["".join(rnd.choice("az") for _ in range(rnd.randrange(5, 14))).encode() for _ in range(12)]
        ids = np.array([rnd.randrange(9) for _ in texts])
        want = {(k, w): min(i for t, i in zip(texts, ids.tolist(), strict=True) if texts[k][w:w + 5] in t) for k in range(12) for w in range(len(texts[k]) - 4)}
        who, win, low = suffixes.window_owners(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), ids, 5)
        assert dict(zip(zip(who.tolist(), win.tolist(), strict=True), low.tolist(), strict=True)) == want


def test_suffix_samples_are_not_shared_by_chance():
    """Texts with common 16-byte words and nothing longer in common share no sample, so none of their text is sent."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(16)) for _ in range(40)]

    def hashes():
        data = np.frombuffer("".join(rnd.choice(words) + "".join(rnd.choice("ijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(2000)).encode(), np.uint8)
        return suffixes.samples(data, np.array([0, len(data)]))[3]
    assert not len(np.intersect1d(hashes(), hashes()))


def test_suffix_pairs_of_shards_and_ranges():
    """A packed row goes from each shard to each range and back: at 10 GB of text (6 GB of Parquet) 3 million rows each way before."""
    shards, ranges, sample_ranges = suffixes._plan(10 << 30)
    assert shards * (ranges + sample_ranges) < 1_200_000
    assert (10 << 30) / min(shards, ranges) <= 16 << 20
    assert suffixes._plan(0) == (8, 8, 8)


def test_suffix_equal_texts_are_equal_bytes(monkeypatch):
    """Texts whose hashes all collide are told apart by their bytes."""
    rnd = random.Random(4)
    texts = [(rnd.choice("ab") + "x" * 50 + rnd.choice("cd") + rnd.choice("ef") * rnd.randrange(3)).encode() for _ in range(300)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    start, deal = np.cumsum(size) - size, np.array([rnd.randrange(3) for _ in texts], np.uint64)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(suffixes, "_hashed", lambda words, start, length, x: np.zeros(len(start), np.uint64))
        order, new = suffixes.same_texts(data, start, size, deal, 50)
        got = [(int(deal[i]), texts[i]) for i in order]
        assert new.tolist() == [True] + [a != b for a, b in zip(got[1:], got, strict=False)]
        assert sorted(order.tolist()) == list(range(300)) and (clash or new.sum() == len(set(got)))


def test_suffix_hot_phrase_is_packed(monkeypatch):
    """A phrase that every document holds: its windows' places and answers take less room than its text."""
    monkeypatch.setattr(suffixes, "HOT", 100)
    rnd = random.Random(9)
    phrase = "".join(rnd.choice("abcdefgh") for _ in range(500))
    rows = [(k, "".join(rnd.choice("ijklmnop") for _ in range(60 + k % 7)) + phrase) for k in range(300)]
    table = pa.table({"shard": pa.array([0] * 300, pa.int32()), "id": [i for i, _ in rows], "th": list(range(300)), "doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    sampled, shared, sent, answered, report, _ = suffixes._tasks(50, 1, 1)
    side = shared(sampled(None, table, suffixes._side([])))
    route = sent(None, table, side)
    answers = answered(route)
    got = report(None, table, answers)
    assert sorted([tuple(r.values()) for r in got.to_pylist()], key=str) == brute_suffixes(rows)
    assert sum(len(b) for t in (route, answers) for b in t.column("blob").to_pylist()) < 300 * len(phrase)


# ---------------------------------------------------------------- SimHash

def fingerprint(text, width=4):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    sh = [b" ".join(w[k:k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def components(fps, bits=4):
    u = np.unique(np.array(fps, np.uint64))
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= bits)
    return dict(zip(u.tolist(), common.local_components(len(u), a, b).tolist(), strict=True))


def test_fingerprints(spark):
    rows = [(1, "One two three four five SIX"), (2, None), (3, "  "), (4, "just three words"), (5, LONG), (6, "é Ü\tx\x0by z " * 9), (6, "a" * 300 + " b c d e")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{fingerprint(t):016x}") for i, t in rows)
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shard_points", [16_384, 40])
def test_near_groups_equal_all_pairs(spark, shard_points):
    rng = np.random.default_rng(1)
    fps = [0] * 5
    for x in rng.integers(0, 1 << 63, 200).tolist():
        for _ in range(6):
            fps.append(x)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
    rows = [(k if k else None, int(np.uint64(x).view(np.int64))) for k, x in enumerate(fps)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), shard_points=shard_points).collect()
    lab = components(fps)
    low = {}
    for k, x in enumerate(fps):
        if k:
            low[lab[x]] = min(k, low.get(lab[x], 1 << 60))
    assert all(r.component_id == low.get(lab[int(np.int64(r.fp).view(np.uint64))]) for r in got)
    assert len(got) == len(fps)


def test_keep_one_keeps_rows_and_columns(spark):
    df = docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "quite another text than that"), (None, "a b c d e")]).withColumn("fp", F.lit(9))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]


def test_keep_one_with_repeated_and_null_ids(spark):
    copy, other = "a b c d e f g h", "quite another text than that one"
    df = docs(spark, [(1, copy), (2, copy), (2, other), (2, other), (4, "一 third"), (4, "一 third"), (4, "and a fourth row of this id"), (None, copy), (None, copy), (None, "unlike all of the others here")])
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect())
    assert got == sorted([("1", copy), ("2", other), ("4", "一 third"), ("4", "and a fourth row of this id"), ("None", copy), ("None", "unlike all of the others here")])


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    lab = common.local_components(1100, np.array([a for a, _ in real]), np.array([b for _, b in real]))
    assert got == {x: int(lab[x]) for e in real for x in e}


# ---------------------------------------------------------------- lines

def brute_lines(rows, min_words=5, min_bytes=30):
    """Spans to remove, by Python's own splitting."""
    seen, spans = {}, {}
    for i, t in sorted(((1 << 63) - 1 if i is None else i, t) for i, t in set(rows) if t is not None):
        raw = t.encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        units = set()
        ends = lambda a: raw[a[1] - 1:a[1]] in (b".", b"!", b"?")
        for breaks in (lambda a, b: False, lambda a, b: ends(a), lambda a, b: ends(a) or 65 <= raw[b[0]] <= 90):
            k = 0
            for n in range(1, len(words) + 1):
                if n == len(words) or breaks(words[n - 1], words[n]) or re.search(rb"[\n\r]", raw[words[n - 1][1]:words[n][0]]):
                    units.add((k, n))
                    k = n
        for a, b in sorted(units):
            body = b" ".join(raw[x:y] for x, y in words[a:b])
            body = bytes(c + 32 if 65 <= c <= 90 else c for c in body)
            if b - a >= min_words and len(body) >= min_bytes:
                seen.setdefault(body, []).append((i, t, words[a][0], words[b][0] if b < len(words) else len(raw)))
    for hits in seen.values():
        keep = min((h[0], h[2]) for h in hits)
        for i, t, a, b in hits:
            if (i, a) != keep:
                spans.setdefault((i, t), []).append((a, b))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        m = np.zeros(len(raw), bool)
        for a, b in spans.get(((1 << 63) - 1 if i is None else i, t), []):
            m[a:b] = True
        out.append((i, len(raw), int(m.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice(["Alpha", "beta", "Gämma", "delta", "epsilon"]) for _ in range(rnd.randrange(2, 12))) + rnd.choice([".", "", "!"]) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "  \n\n "), (4, LONG), (5, LONG)]
    for k in range(60):
        rows.append((100 + k, "".join(rnd.choice(pool) + rnd.choice([" ", "\n", "\n\n", "  "]) for _ in range(rnd.randrange(8)))))
    rows += [rows[-1], (None, "\n".join(pool[:6]))]
    df = docs(spark, rows).withColumns({"spans": F.lit(1), "id": F.lit(2)})
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect()), key=str)
    assert got == brute_lines(rows)
    kept = substrings.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()), key=str) == sorted([(x[0], x[3]) for x in got], key=str)
    assert {r.text for r in kept.filter("doc_id = 1").collect()} == {None}


@pytest.mark.parametrize("text,words", [("Ha " * 60, 20), ("One Two Three Four Five " * 12, 20), ("Ab cd. " * 40, 20)])
def test_a_unit_that_overlaps_itself_keeps_its_first_occurrence(spark, text, words):
    kept = {r.doc_id: r.text for r in substrings.dedup(docs(spark, [(1, text), (2, text), (3, "Other words here.")]), part_words=substrings.RUN_WORDS).collect()}
    assert kept[1].split() == text.split()[:words] and kept[2] == "" and kept[3] == "Other words here."


def test_line_dedup_in_many_packs_and_ranges(spark, monkeypatch):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(["Alpha", "beta", "Gämma", "delta", "epsilon"]) for _ in range(rnd.randrange(4, 12))) + "." for _ in range(30)]
    rows = [(k // 2, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(12)))) for k in range(200)] + [(7, "The same row over and over again, here it is.")] * 40
    whole = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substrings.report(docs(spark, rows)).collect())
    monkeypatch.setattr(substrings, "PACK_UNITS", 5)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 900)
    assert whole == sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substrings.report(docs(spark, rows).repartition(9)).collect())


def test_line_dedup_empty_table(spark):
    assert substrings.report(docs(spark, [])).count() == 0
    assert substrings.dedup(docs(spark, [])).count() == 0


def passage(letters, seed, n=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(n)]


def hosted(middle, letters="abcdefghij", sep=" "):
    """Two documents with ``middle`` set inside their only line, and what stands before and behind it in the second."""
    a, b, c, d = (sep.join(passage(letters, k, 12)) for k in (91, 92, 93, 94))
    return [(1, sep.join([a, middle, b])), (2, sep.join([c, middle, d]))], c, d


@pytest.mark.parametrize("letters", ["klmnopqrst", "éèàùçôîêâû", "אבגדהוזחטי", "কখগঘঙচছজঝঞ"])
def test_a_passage_inside_a_line_goes_in_any_script(spark, letters):
    rows, before, behind = hosted(" ".join(passage(letters, 1)))
    got = {r.doc_id: r.text for r in substrings.dedup(docs(spark, rows), part_words=substrings.RUN_WORDS).collect()}
    assert got[1] == rows[0][1]
    assert got[2].startswith(before) and got[2].endswith(behind)
    assert len(got[2]) - len(before) - len(behind) < 0.5 * (len(rows[1][1]) - len(before) - len(behind))


def test_a_passage_without_spaces_goes(spark):
    rows, before, behind = hosted("。".join(passage("的一是不了人我在有他", 1, 12)) + "。", "这中大来上国个到说们", "")
    got = {r.doc_id: r.text for r in substrings.dedup(docs(spark, rows), part_words=substrings.RUN_WORDS).collect()}
    assert got[1] == rows[0][1] and got[2].startswith(before) and got[2].endswith(behind)
    assert len(got[2]) - len(before) - len(behind) < 0.5 * (len(rows[1][1]) - len(before) - len(behind))


@pytest.mark.parametrize("first", ["Klmn", "Éklm", "Źklm", "Жклм"])
def test_a_passage_of_short_sentences_and_nouns_goes_whole(spark, first):
    w = passage("klmnopqrst", 2, 45)
    middle = " ".join([first, *(x.capitalize() if k % 3 == 0 else x + "." if k % 7 == 1 else x for k, x in enumerate(w)), "end."])
    rows, before, behind = hosted(middle)
    got = {r.doc_id: r.text for r in substrings.dedup(docs(spark, rows), part_words=substrings.RUN_WORDS).collect()}
    assert got == {1: rows[0][1], 2: f"{before} {behind}"}


def test_a_rewrapped_passage_goes(spark):
    w = passage("klmnopqrst", 3)
    rows = [(1, " ".join(["Begin", *w, "end."])), (2, "x\n" + "\n".join(" ".join((["Begin", *w, "end."])[k:k + 7]) for k in range(0, 62, 7)))]
    got = {r.doc_id: r.text for r in substrings.dedup(docs(spark, rows), part_words=substrings.RUN_WORDS).collect()}
    assert got == {1: rows[0][1], 2: "x\n"}


def test_a_short_fragment_between_capitals_stays(spark):
    rows = [(1, "Anna wrote However in the light of these matters Bert answered nothing at all"), (2, "Carl thought However in the light of these matters Dora went home again")]
    assert {(r.doc_id, r.text) for r in substrings.dedup(docs(spark, rows), part_words=substrings.RUN_WORDS).collect()} == set(rows)
