"""Substring dedup by line hashing: units are lines, the sentences inside them, the parts of a sentence that begin with
a capital, and runs of at least ``RUN_WORDS`` words between content-defined cuts.

The cuts of a document are the words after a sentence end, the words that begin with a capital (both of any script), and the
words whose hash with the next one is the only least one within ``REACH`` words.  They depend on the words nearby alone, so a
passage has the same cuts wherever it is set, whatever its case or script and however its lines are wrapped: it goes from its first
cut to its last, short sentences included.  From each cut the shortest run onward is a unit, and to each sentence end the shortest before it.

A unit's words (A-Z lower-cased, single-spaced; a character of a script without spaces is a word) are digested to 128 bits.  Per
digest the earliest occurrence, ranked by (doc_id, offset), stays; every other one is removed, but for what it shares with the earliest
in the same text.  Removed spans keep their byte offsets in the original text.  Lines and sentences under ``min_words`` words, parts under ``part_words`` words and units under
``min_bytes`` bytes are never removed.

Edge cases: null text stays null, empty text empty; a null doc_id ranks last; rows that repeat both
doc_id and text are one document (each gets the same spans); extra columns pass through ``dedup`` unread.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, only, text_buffers, text_pieces, word_layout, words64, xxh64

MIN_WORDS = 5
MIN_BYTES = 30
RUN_WORDS = 20            # words of a run, and of a part in the registered queries
REACH = 4                 # words on either side that a cut's hash undercuts
PACK_UNITS = 400_000      # units whose first occurrences a task sorts out before it sends them
RANGE_BYTES = 32_000_000  # text whose units make a range of digests
_LAST = (1 << 63) - 1

#: sentence ends besides . ! ? (last bytes of a word)
_ENDS = [c.encode() for c in "\u061f\u06d4\u0589\u0964\u0965\u1362\u1367\u203c\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61\u104b\u17d4"]
#: scripts without spaces: (first, last) lead bytes with the byte behind
_SOLID = [(0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFBC, 0xEFBD), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3)]


@functools.cache
def _capitals() -> np.ndarray:
    return np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x1F000)])


def _at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes at positions; 0 outside."""
    ok = (at >= 0) & (at < len(data))
    return np.where(ok, data[np.where(ok, at, 0)], 0).astype(np.int64)


def _solid(data: np.ndarray) -> np.ndarray:
    """Positions before and behind each character of a script without spaces."""
    lead = np.flatnonzero(data >= 0xE0)
    two = (data[lead].astype(np.int64) << 8) | _at(data, lead + 1)
    on = np.zeros(len(lead), bool)
    for lo, hi in _SOLID:
        on |= (two >= lo) & (two <= hi)
    lead = lead[on]
    return np.unique(np.concatenate([lead, lead + np.where(data[lead] >= 0xF0, 4, 3)]))


def _closes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    last = data[stops - 1]
    out = (last == 46) | (last == 33) | (last == 63)          # . ! ?
    far = np.flatnonzero(last >= 0x80)
    tail = [_at(data, stops[far] - k) for k in (1, 2, 3)]
    for c in _ENDS:
        hit = stops[far] - begins[far] >= len(c)
        for k, b in enumerate(reversed(c)):
            hit &= tail[k] == b
        out[far[hit]] = True
    return out


def _capital(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    b = data[begins]
    out = (b >= 65) & (b <= 90)
    far = np.flatnonzero(b >= 0xC0)
    a, x, y, z = (_at(data, begins[far] + k) for k in range(4))
    code = np.where(a < 0xE0, (a & 31) << 6 | x & 63, np.where(a < 0xF0, (a & 15) << 12 | (x & 63) << 6 | y & 63, (a & 7) << 18 | (x & 63) << 12 | (y & 63) << 6 | z & 63))
    out[far] = _capitals()[np.minimum(code, 0x1EFFF)]
    return out


def _least(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words whose hash with the next word is the only least one within ``REACH`` words of their row."""
    size = (ends - starts).astype(np.uint64)
    word = words64(body)[starts]
    short = size < 8
    word[short] &= (np.uint64(1) << (size[short] * np.uint64(8))) - np.uint64(1)
    tail = words64(body)[np.maximum(ends - 8, starts)]
    tail[short] = 0
    h = mix64(word ^ mix64(tail + size))
    g = h.copy()
    with np.errstate(over="ignore"):
        g[:-1] = mix64(h[:-1] * np.uint64(3) + np.where(head[1:], np.uint64(0), h[1:]))
    out = np.ones(len(g), bool)
    for d in range(1, REACH + 1):
        same = row[d:] == row[:-d]
        out[:-d] &= ~same | (g[:-d] < g[d:])
        out[d:] &= ~same | (g[d:] < g[:-d])
    return out


def _runs(cut: np.ndarray, e: np.ndarray, row_first: np.ndarray, row: np.ndarray, least: int):
    """(first, last + 1) of the shortest runs of ``least`` words or more from each cut onward, and from a cut to before each word of ``e``."""
    n = len(cut)
    edge = np.concatenate([np.flatnonzero(cut), [n]])
    low, high = row_first[:-1], row_first[1:]
    a = edge[:-1]
    to = np.searchsorted(edge, a + least)
    b = edge[np.minimum(to, len(edge) - 1)]
    on = (to < len(edge)) & (b <= high[row[a]])
    s = edge[np.maximum(np.searchsorted(edge, e - least, side="right") - 1, 0)]
    ok = (e - s >= least) & (s >= low[row[e - 1]])
    return np.concatenate([a[on], s[ok]]), np.concatenate([b[on], e[ok]])


def unit_spans(data: np.ndarray, offsets: np.ndarray, min_words: int, min_bytes: int, part_words: int = MIN_WORDS, run_words: int = RUN_WORDS):
    """(row, start, stop, digest high, digest low) of the units of a piece.

    ``stop`` reaches to the next word, so that the white space behind a unit goes with it.
    """
    body, starts, ends, row_first, begins, stops = word_layout(data, offsets, _solid(data))
    n = len(begins)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(row_first))
    newline = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
    head = np.concatenate([[True], row[1:] != row[:-1]])
    line = head.copy()
    line[1:] |= newline[begins[1:]] > newline[stops[:-1]]
    stop = head.copy()
    stop[1:] |= _closes(data, begins, stops)[:-1]
    sentence = line | stop
    capital = _capital(data, begins)
    after = np.concatenate([np.where(head[1:], offsets[1:][row[:-1]], begins[1:]), offsets[-1:]])
    spans = []
    for new, least in ((line, min_words), (sentence, min_words), (sentence | capital, part_words)):
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) - 1
        on = last - first + 1 >= least
        spans.append(first[on] * (n + 1) + last[on])
    behind = np.flatnonzero(np.concatenate([stop[1:], [True]])) + 1
    first, behind = _runs(stop | capital | _least(body, starts, ends, head, row), behind, row_first, row, run_words)
    spans.append(first * (n + 1) + behind - 1)
    span = np.unique(np.concatenate(spans))
    a, b = span // (n + 1), span % (n + 1)
    on = ends[b] - starts[a] >= min_bytes
    a, b = a[on], b[on]
    hi, lo = xxh64(body, starts[a], ends[b], 42), xxh64(body, starts[a], ends[b], 0x5BD1E995)
    base = offsets[:-1][row[a]]
    return row[a], begins[a] - base, after[b] - base, hi.view(np.int64), lo.view(np.int64)


_DOC = ["id", "th"]


def _written(**columns) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(blob) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(blob).read_all()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _later(order: np.ndarray, hi, lo, ids, th, start, stop):
    """Of the occurrences in ``order`` (by digest, then rank): which are their digest's first, and the places, starts and stops
    to remove of the others.  The part of one that overlaps the first in its own document stays."""
    same = np.zeros(len(order), bool)
    same[1:] = (hi[order[1:]] == hi[order[:-1]]) & (lo[order[1:]] == lo[order[:-1]])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    own = (ids[order] == ids[head]) & (th[order] == th[head])
    a = np.where(own, np.maximum(start[order], stop[head]), start[order])
    on = same & (a < stop[order]) & ~(own & (start[order] == start[head]))          # a repeated row's copy is the first itself
    return order[~same], order[on], a[on], stop[order[on]]


def _by_document(ids, th, start, stop):
    """(id, th, packed spans) of each document that loses some."""
    order = np.lexsort((start, th, ids))
    ids, th = ids[order], th[order]
    spans = np.stack([start[order], stop[order]], axis=1).astype("<i4")
    edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(ids))[:len(edge)]
    return ids[edge], th[edge], [spans[x:y].tobytes() for x, y in zip(edge, ends, strict=True)]


def _packs(docs: DataFrame, ranges: int, min_words: int, min_bytes: int, part_words: int) -> DataFrame:
    """(range, blob): each pack of documents' first occurrences, one blob a range of digests; and what a pack's later ones remove."""
    rows = only(docs, doc_id="bigint", text="string").filter("text is not null").select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("th"), "text")
    out = pa.schema([("range", pa.int64()), ("blob", pa.binary())])

    def pack(held):
        ids, th, start, stop, hi, lo = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, th, ids, lo, hi))
        first, gone, a, b = _later(order, hi, lo, ids, th, start, stop)
        place = (hi[first] >> 32) + (1 << 31)                                        # order of hi, as unsigned 32 bits
        edge = np.searchsorted(place, -(-np.arange(ranges + 1) * (1 << 32) // ranges))
        blobs = [(k, first[x:y]) for k, (x, y) in enumerate(itertools.pairwise(edge)) if y > x]
        names = [k for k, _ in blobs]
        made = [_written(hi=hi[f], lo=lo[f], id=ids[f], th=th[f], start=start[f].astype(np.int32), size=(stop[f] - start[f]).astype(np.int32)) for _, f in blobs]
        if len(gone):
            names.append(int(np.bitwise_xor.reduce(th[gone]) % ranges))
            made.append(_written(id=ids[gone], th=th[gone], start=a.astype(np.int32), stop=b.astype(np.int32)))
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(made, pa.binary())], schema=out)

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            ids, th = (batch.column(c).to_numpy() for c in _DOC)
            for a, _b, data, offsets in text_pieces(batch.column("text")):
                row, start, stop, hi, lo = unit_spans(data, offsets, min_words, min_bytes, part_words)
                if len(row):
                    held.append((ids[row + a], th[row + a], start, stop, hi, lo))
                size += len(row)
                if size >= PACK_UNITS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(cut, "range bigint, blob binary")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, part_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, spans): per document what to remove, as packed pairs (start, stop) of 32-bit byte offsets, a blob a range.

    Units are cut once.  A pack keeps its own first occurrence of a digest and sends that alone, so a unit that every document holds is a
    row's entry a pack, not one a document; what a pack knows to be later goes straight back.
    """
    n = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    packs = _packs(docs, max(1, -(-n // RANGE_BYTES)), min_words, min_bytes, part_words)

    def run(_key, table):
        held, gone = [], []
        for blob in table.column("blob"):
            t = _read(blob.as_buffer())
            if "hi" in t:
                held.append((t["id"], t["th"], t["start"].astype(np.int64), t["start"].astype(np.int64) + t["size"], t["hi"], t["lo"]))
            else:
                gone.append((t["id"], t["th"], t["start"], t["stop"]))
        if held:
            ids, th, start, stop, hi, lo = (np.concatenate(c) for c in zip(*held, strict=True))
            _, later, a, b = _later(np.lexsort((start, th, ids, lo, hi)), hi, lo, ids, th, start, stop)
            gone.append((ids[later], th[later], a, b))
        ids, th, spans = _by_document(*(np.concatenate(c) for c in zip(*gone, strict=True)))
        return pa.table([pa.array(ids), pa.array(th), pa.array(spans, pa.binary())], names=[*_DOC, "span"])

    found = packs.groupBy("range").applyInArrow(run, "id bigint, th bigint, span binary")
    return found.groupBy(*_DOC).agg(F.collect_set("span").alias("spans"))             # a blob a range and pack that lets it go


def merge_spans(start: np.ndarray, stop: np.ndarray):
    """Maximal runs of sorted, possibly nested or touching spans."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:], [len(start)]]) - 1]


def _with_spans(docs: DataFrame, min_words: int, min_bytes: int, part_words: int) -> DataFrame:
    gone = repeated_spans(docs, min_words, min_bytes, part_words)
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "__th": F.xxhash64(F.col("text").cast("string"))})
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    return keyed.join(gone, ["__id", "__th"], "left")


def _remove(text: np.ndarray, offsets: np.ndarray, spans) -> list:
    """Per row (removed runs, kept bytes); ``spans``: rows' lists of packed (start, stop) pairs, or None."""
    got = []
    for k, s in enumerate(spans):
        row = text[offsets[k]:offsets[k + 1]]
        if not s:
            got.append(([], row.tobytes()))
            continue
        pairs = np.frombuffer(b"".join(s), "<i4").reshape(-1, 2).astype(np.int64)
        a, b = merge_spans(*pairs[np.argsort(pairs[:, 0], kind="stable")].T)
        cut = np.zeros(len(row) + 1, np.int32)
        np.add.at(cut, a, 1)
        np.add.at(cut, b, -1)
        got.append((list(zip(a.tolist(), b.tolist(), strict=True)), row[np.cumsum(cut[:-1]) == 0].tobytes()))
    return got


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, part_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units removed from ``text`` (columns and rows as before)."""
    joined = _with_spans(docs, min_words, min_bytes, part_words).select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__spans"))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            columns = list(batch.columns[:-1])
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                text = columns[at]
                data, offsets = text_buffers(text.take(pa.array(hit)))
                kept = [x[1].decode() for x in _remove(data, offsets, spans.take(pa.array(hit)).to_pylist())]
                mask = np.zeros(batch.num_rows, bool)
                mask[hit] = True
                columns[at] = pc.replace_with_mask(text, pa.array(mask), pa.array(kept, text.type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def report(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, part_words: int = MIN_WORDS) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), spans, kept_sha256."""
    joined = _with_spans(docs.select("doc_id", "text"), min_words, min_bytes, part_words)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("spans", pa.list_(span))])

    def digest(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            got = _remove(data, offsets, batch.column("spans").to_pylist())
            size = np.diff(offsets)
            kept = [len(x[1]) for x in got]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(size), pa.array((size - np.array(kept, np.int64)).astype(np.int64)),
                pa.array([len(x[0]) for x in got], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in got]),
                pa.array([[{"start": a, "stop": b} for a, b in x[0]] for x in got], pa.list_(span))], schema=out)

    return (joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__spans").alias("spans"))
            .mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                                "spans array<struct<start:bigint,stop:bigint>>"))
