"""Substring dedup on bytes with suffix arrays.

Every byte goes that lies in a ``length``-byte string which also starts in a document with a smaller doc_id.  Steps:

1. Texts that repeat an earlier document's whole text are known by their SHA-256; they lose every byte (if ``length`` long)
   and take no further part.
2. Documents are hashed to shards, by id and text (many texts of one id, or without an id, part too).  Each ``length``-byte window has one sampled suffix: the one that starts with its leftmost least
   24-gram hash, so equal windows have equal samples wherever they stand.  Shards' sorted samples meet by hash range;
   those found in two documents go back, and each shard finds its own among them by binary search.
3. Only the windows of such samples can repeat.  Their text (one context per run of windows that share a sample) goes to
   the range of the sample's hash.  There a suffix array is built (Larsson-Sadakane: groups of equal prefixes of 8, 16, 32, ...
   bytes refined by the ranks behind them), Kasai's common prefixes delimit the runs of equal windows, and
   each window learns the smallest doc_id that has it.
4. Shards mark the windows whose smallest doc_id is below the document's.

A shard sends each distinct context once, with its smallest doc_id and where it stands, so the text of a passage that a third of all
documents hold is one row a shard, and the answers are places.  A sample with very many contexts (a common phrase) is dealt
window by window, by the window's own hash; its windows are answered by number, and their places, which repeat with the phrase,
go from the shard to itself in one packed row.

A (shard, range) pair is one packed row.  Pairs grow with the square of the text, so shards and ranges are as large as a task's
memory lets them be; a range's suffix arrays are built one after the other, over the contexts of so many samples as ``BATCH`` holds.

Edge cases: null text is empty; texts under ``length`` bytes keep all; a null doc_id ranks last; rows of one doc_id never remove
each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, only, pieces, text_buffers, words64

LENGTH = 50
GRAM = 24                  # bytes of a sample's hash: short ones are shared by chance, long ones stand for few windows
SHARD_BYTES = 16 << 20     # text of a shard, as planned
RANGE_BYTES = 8 << 20      # text behind one hash range of contexts, as planned
WIDE = 4                   # ranges of contexts to one of samples
SPREAD = 48                # shards and ranges of a smaller table
BATCH = 1 << 19            # context text of one suffix array (about 70 bytes a byte)
HOT = 2_000                # occurrences from which a sample is dealt window by window
PIECE = 1 << 18
HASH_BYTES = 6             # of a sample's hash that are sent: others that share them cost a look, no result
_CODEC = pa.Codec("zstd")
_LAST = (1 << 63) - 1
_NONE = np.zeros(0, np.int64)
_REST = np.uint64(64 - 8 * HASH_BYTES)


# ---------------------------------------------------------------- samples of a shard

def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(row, first window start, number of windows, hash) of the runs of windows that share a sampled suffix."""
    gram = min(GRAM, max(8, length // 16 * 8))
    width = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return _NONE, _NONE, _NONE, np.zeros(0, np.uint64)
    w = words64(data)
    g = len(data) - gram + 1
    with np.errstate(over="ignore"):
        h = w[:g] * np.uint64(0x9E3779B97F4A7C15)
        for o in range(8, gram, 8):
            h ^= h >> np.uint64(29)
            h += w[o:o + g]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    key = (h >> bits << bits) | np.arange(g, dtype=np.uint64)
    span = 1
    while span * 2 <= width:                           # least key of every window by doubling
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[:n], key[width - span:width - span + n])
    size = np.diff(offsets)
    full = np.maximum(size - length + 1, 0)            # windows that stay in their document
    ok = np.repeat(np.tile([True, False], len(size)), np.stack([full, size - full], 1).ravel())[:n]
    new = ok & np.concatenate([[True], (key[1:] != key[:-1]) | ~ok[:-1]])
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, side="right") - 1
    count = np.minimum(np.concatenate([start[1:], [n]])[:len(start)], (offsets[:-1] + full)[row]) - start
    at = (key[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return row, start, count, mix64(h[at]) >> _REST << _REST       # mixed again: least hashes are all small


def _offsets(length: int) -> list[int]:
    """Where 8-byte words stand that cover ``length`` bytes."""
    return [*range(0, length - 8, 8), length - 8]


def _words(data: np.ndarray) -> np.ndarray:
    """As ``words64``, without a copy: for a few places among many."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", buffer=padded.data, strides=(1,))


def _hashed(words: np.ndarray, start: np.ndarray, length: int, x: np.ndarray) -> np.ndarray:
    """``x`` mixed with the ``length`` bytes at each start."""
    with np.errstate(over="ignore"):
        for o in _offsets(length):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + words[start + o])
    return x


def same_texts(data: np.ndarray, start: np.ndarray, size: np.ndarray, deal: np.ndarray, length: int):
    """(order of the texts by deal with equal ones side by side, which of them in that order differ from the one before).

    A text is a context: its first and its last ``length`` bytes are the whole of it.  Hashes order, bytes decide.
    """
    w, tail = _words(data), start + size - length
    key = _hashed(w, tail, length, _hashed(w, start, length, size.astype(np.uint64)))
    order = np.lexsort((key, deal))
    a, b = order[:-1], order[1:]
    same = (deal[a] == deal[b]) & (key[a] == key[b]) & (size[a] == size[b])
    for o in _offsets(length):
        for first in (start, tail):
            at = np.flatnonzero(same)
            same[at] = w[first[a[at]] + o] == w[first[b[at]] + o]
    return order, np.concatenate([[True], ~same])[:len(start)]


class Shard:
    """The documents of one shard that take part, and their samples."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int):
        self.ids, self.data, self.offsets, self.length = ids, data, offsets, length
        rows, starts, counts, hashes = [], [], [], []
        for a, b in pieces(offsets, PIECE):
            lo = offsets[a]
            r, s, c, h = samples(data[lo:offsets[b]], offsets[a:b + 1] - lo, length)
            rows.append(r + a)
            starts.append(s + lo)
            counts.append(c)
            hashes.append(h)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.row, self.start, self.count = cat(rows, np.int64), cat(starts, np.int64), cat(counts, np.int64)
        self.hash = cat(hashes, np.uint64)

    def summary(self):
        """Distinct sample hashes in order, with a byte each: occurrences, saturated; 255 also if two documents have it."""
        order = np.argsort(self.hash, kind="stable")
        h, doc = self.hash[order], self.ids[self.row[order]]
        if not len(h):
            return h, np.zeros(0, np.uint8), np.zeros(0, bool)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        n = np.diff(np.concatenate([first, [len(h)]]))
        return h[first], np.minimum(n, 127).astype(np.uint8), many

    def contexts(self, shared: np.ndarray, hot: np.ndarray):
        """Contexts of the shared samples: (hash to deal by, row, first window start, windows), and how many of them are cold; single windows of hot samples follow."""
        some = np.zeros(1 << 22, bool)                 # most hashes are no shared one's: seen by their first bits
        some[shared >> np.uint64(42)] = True
        on = np.flatnonzero(some[self.hash >> np.uint64(42)])
        k = np.searchsorted(shared, self.hash[on])
        k = np.minimum(k, max(0, len(shared) - 1))
        same = shared[k] == self.hash[on]
        on, heat = on[same], hot[k[same]]
        cold, warm = on[~heat], on[heat]
        n = self.count[warm]
        single = np.repeat(self.start[warm] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.concatenate([self.row[cold], np.repeat(self.row[warm], n)])
        start = np.concatenate([self.start[cold], single])
        count = np.concatenate([self.count[cold], np.ones(len(single), np.int64)])
        deal = np.concatenate([self.hash[cold], _hashed(_words(self.data), single, self.length, np.zeros(len(single), np.uint64))])
        return deal, row, start, count, len(cold)


# ---------------------------------------------------------------- suffix array of contexts

def _stable(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys below 2 ** bits: sorted with their places as one number, where both fit."""
    b = len(key).bit_length()
    if bits + b > 64:
        return np.argsort(key, kind="stable")
    k = key.astype(np.uint64) << np.uint64(b) | np.arange(len(key), dtype=np.uint64)
    k.sort()
    return (k & np.uint64((1 << b) - 1)).astype(np.int64)


def suffix_array(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes; ``left`` is how many bytes each has before its context ends.

    Larsson-Sadakane: suffixes are grouped by their first h bytes (a machine word with the place in it to begin with); only groups of several are refined, by the group
    numbers h bytes on, and h doubles.  Equal suffixes of different contexts keep their order of position.
    """
    n = len(data)
    word = words64(data).byteswap()                   # big-endian words compare as bytes do
    short = left < 8
    word[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left[short].astype(np.uint64))
    bits = n.bit_length()
    h = (64 - bits) // 8                               # bytes that can be sorted with the places
    word >>= np.uint64(64 - 8 * h)
    order = _stable(word, 8 * h).astype(np.int32)
    x = word[order]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if n else np.zeros(0, bool)
    del word, x
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(head, np.diff(np.concatenate([head, [n]])))   # number of a group: its first place
    where = np.arange(n, dtype=np.int32)               # places of unsorted groups
    while True:
        size = np.diff(np.concatenate([head, [len(where)]])) if len(where) else _NONE
        where = where[np.repeat(size > 1, size)]
        if not len(where):
            break
        i = order[where]
        more = left[i] > h
        group = rank[i]
        # a group whose members have all ended holds equal suffixes: sorted
        live = np.zeros(n, bool)
        live[group[more]] = True
        on = live[group]
        where, i, group, more = where[on], i[on], group[on], more[on]
        if not len(where):
            break
        nxt = np.where(more, rank[np.minimum(i + h, n - 1)], -1)
        o = _stable(group.astype(np.int64) * (n + 1) + nxt + 1, 2 * bits)
        i, group, nxt = i[o], group[o], nxt[o]
        order[where] = i
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        head = np.flatnonzero(new)
        rank[i] = np.repeat(where[head], np.diff(np.concatenate([head, [len(where)]])))
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, left: np.ndarray, starts: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's common prefix (up to ``limit``) of each place of ``order`` with the place before it.

    A suffix's common prefix is at least that of the suffix one byte further left, less one; all contexts
    (``starts``) take their steps side by side.  Suffixes shorter than ``limit`` are left at 0: none of them stands between
    two suffixes that share ``limit`` bytes.
    """
    n = len(data)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.concatenate([[-1], order[:-1]]).astype(np.int32)[place]     # by position
    out = np.zeros(n, np.int32)
    size = np.maximum(left[starts].astype(np.int64) - limit + 1, 0)
    lanes = np.argsort(-size, kind="stable")
    at, length, cur = starts[lanes], size[lanes], np.zeros(len(starts), np.int64)
    for t in range(int(size.max()) if len(size) else 0):
        m = int(np.searchsorted(-length, -t, side="left"))       # lanes longer than t
        at, length, cur = at[:m], length[:m], np.maximum(cur[:m] - 1, 0)
        i = at + t
        j = before[i]
        top = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), limit), 0)
        cur = np.minimum(cur, top)
        go = np.flatnonzero(cur < top)
        while len(go):
            same = data[i[go] + cur[go]] == data[j[go] + cur[go]]
            go = go[same]
            cur[go] += 1
            go = go[cur[go] < top[go]]
        out[place[i]] = cur
    return out


def window_owners(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH):
    """(text number, window, smallest id) for every window of the texts end to end in ``data``: the least id of the texts that have its bytes."""
    if not len(sizes):
        return _NONE, _NONE, _NONE
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = (np.arange(len(data)) - starts[owner]).astype(np.int32)
    left = sizes[owner].astype(np.int32) - inside
    order, _ = suffix_array(data, left)
    lcp = common_prefixes(data, left, starts, order, length)
    full = left[order] >= length                        # windows
    places = np.flatnonzero(full)
    if not len(places):
        return _NONE, _NONE, _NONE
    # the common prefix of neighbouring windows is the least one over the places between them
    low = np.minimum.reduceat(lcp[:places[-1] + 1], np.concatenate([[0], places[:-1] + 1]))
    run = np.concatenate([[True], low[1:] < length])
    head = np.flatnonzero(run)
    who = owner[order[places]]
    least = np.repeat(np.minimum.reduceat(ids[who], head), np.diff(np.concatenate([head, [len(places)]])))
    return who, inside[order[places]], least


# ---------------------------------------------------------------- packing

def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(blob[at:at + 8], "little")
        out.append(np.frombuffer(blob, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = _pack(*arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unsqueeze(blob: bytes, *types) -> list[np.ndarray]:
    return _unpack(_CODEC.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True), *types)


def _cut(hashes: np.ndarray) -> np.ndarray:
    """The first ``HASH_BYTES`` bytes of each."""
    return np.ascontiguousarray(hashes.astype("<u8", copy=False)[:, None].view(np.uint8)[:, 8 - HASH_BYTES:]).ravel()


def _whole(cut: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cut) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES:] = cut.reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _spread(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, ``first`` and on) for ``n`` steps of each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which))


def _by_range(deal: np.ndarray, ranges: int):
    """Order of the rows by hash range, and the (range, first, stop) of each that occurs."""
    part = ((deal >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    p = part[order]
    if not len(p):
        return order, []
    head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return order, [(int(p[a]), int(a), int(b)) for a, b in zip(head, np.concatenate([head[1:], [len(p)]]), strict=True)]


_SIDE = "shard int, kind int, id bigint, th bigint, part int, blob binary"
_SIDE_PA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])
_COPY, _SHARED, _ANSWER, _HOT_ANSWER, _HOT_PLACES = range(5)
_ROUTE = "part int, shard int, blob binary"


def _routed(rows) -> pa.Table:
    rows = list(rows)
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()),
                     "blob": pa.array([r[2] for r in rows], pa.binary())})


def _side(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SIDE_PA)], schema=_SIDE_PA)


class _Input:
    """One shard's documents and side rows as a task gets them."""

    def __init__(self, docs: pa.Table, side: pa.Table, length: int):
        self.length = length
        docs = docs.sort_by([("id", "ascending"), ("th", "ascending")])
        kind = side.column("kind").to_numpy()
        part = side.filter(pa.array(kind == _COPY))
        gone = set(zip(part.column("id").to_pylist(), part.column("th").to_pylist(), strict=True))
        self.doc_id = docs.column("doc_id")
        self.ids = docs.column("id").to_numpy()
        self.data, self.offsets = text_buffers(docs.column("text"))
        th = docs.column("th").to_pylist()
        self.copy = np.array([(i, t) in gone for i, t in zip(self.ids.tolist(), th, strict=True)], bool)
        stay = np.flatnonzero(~self.copy)
        size = np.diff(self.offsets)
        self.size = size
        self.shard_no = docs.column("shard")[0].as_py() if docs.num_rows else None
        keep = np.repeat(~self.copy, size)
        self.text = self.data[keep] if self.copy.any() else self.data
        self.stay = stay
        self.offs = np.concatenate([[0], np.cumsum(size[stay])]).astype(np.int64)
        self.side, self.kind = side, kind

    def blobs(self, kind: int) -> list[bytes]:
        return self.side.filter(pa.array(self.kind == kind)).column("blob").to_pylist()

    def shard(self) -> Shard:
        return Shard(self.ids[self.stay], self.text, self.offs, self.length)

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Shared samples in order, and which of them are hot."""
        shared = [_unpack(b, "u1", "u1") for b in self.blobs(_SHARED)]
        h = _whole(np.concatenate([x[0] for x in shared])) if shared else np.zeros(0, np.uint64)
        f = np.concatenate([x[1] for x in shared]) if shared else np.zeros(0, np.uint8)
        o = np.argsort(h)
        return h[o], f[o] > 0


def _tasks(length: int, ranges: int, sample_ranges: int):
    """The functions that the Spark job applies to shards and ranges."""

    def sampled(_key, docs, side):
        x = _Input(docs, side, length)
        h, n, many = x.shard().summary()
        order, parts = _by_range(h, sample_ranges)
        return _routed((p, x.shard_no, _pack(_cut(h[order[a:b]]), n[order[a:b]] | (many[order[a:b]].astype(np.uint8) << 7))) for p, a, b in parts)

    def shared(table):
        blobs = [(_whole(h), n) for h, n in (_unpack(b, "u1", "u1") for b in table.column("blob").to_pylist())]
        shards = table.column("shard").to_pylist()
        h = np.concatenate([b[0] for b in blobs])
        n = np.concatenate([b[1] for b in blobs])
        order = np.argsort(h, kind="stable")
        s = h[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        code = n[order]
        total = np.add.reduceat((code & 127).astype(np.int64), head)
        twice = (np.diff(np.concatenate([head, [len(s)]])) > 1) | (np.maximum.reduceat(code, head) > 127)
        both = s[head][twice]
        hot = total[twice] >= HOT

        def out():
            for shard, (own, _) in zip(shards, blobs, strict=True):
                k = np.minimum(np.searchsorted(both, own), max(0, len(both) - 1))
                on = both[k] == own if len(both) else np.zeros(len(own), bool)
                if on.any():
                    yield shard, _SHARED, None, None, None, _pack(_cut(own[on]), hot[k[on]].astype(np.uint8))
        return _side(out())

    def sent(_key, docs, side):
        x = _Input(docs, side, length)
        shard = x.shard()
        deal, row, start, count, cold = shard.contexts(*x.shared())
        if not len(row):
            return _routed([])
        order, new = same_texts(shard.data, start, count + length - 1, deal, length)
        head = np.flatnonzero(new)
        number = np.empty(len(order), np.uint32)
        number[order] = np.cumsum(new) - 1
        hot = np.argsort(start[cold:], kind="stable") + cold
        places = np.diff(start[hot], prepend=0).astype(np.uint32), number[hot]     # a phrase's steps and numbers recur: packed well
        pick = order[head]
        times = np.where(pick < cold, np.diff(np.concatenate([head, [len(order)]])), 0)    # hot windows are answered by number
        least, most = (f.reduceat(shard.ids[row[order]], head) for f in (np.minimum, np.maximum))
        place = start[order[order < cold]].astype(np.uint32)
        deal, size, raw = deal[pick], (count[pick] + length - 1).astype(np.uint8), shard.data.tobytes()
        starts = start[pick].tolist()
        stops = (start[pick] + size).tolist()
        order, parts = _by_range(deal, ranges)          # as they are: texts come by deal
        last = np.concatenate([[0], np.cumsum(times)])

        def out():
            if len(hot):
                yield x.shard_no % ranges, -1 - x.shard_no, _squeeze(*places)
            for p, a, b in parts:
                body = b"".join([raw[i:j] for i, j in zip(starts[a:b], stops[a:b], strict=True)])
                yield p, x.shard_no, _squeeze(np.array([a], np.uint32), size[a:b], times[a:b].astype(np.uint32), place[last[a]:last[b]], least[a:b], (least < most)[a:b], deal[a:b], np.frombuffer(body, np.uint8))
        return _routed(out())

    def answered(table):
        rows = list(zip(table.column("shard").to_pylist(), table.column("blob").to_pylist(), strict=True))
        passed = [(-1 - shard, _HOT_PLACES, None, None, None, blob) for shard, blob in rows if shard < 0]
        rows = [r for r in rows if r[0] >= 0]
        if not rows:
            return _side(passed)
        shards = [shard for shard, _ in rows]
        blobs = [_unsqueeze(b, "<u4", "u1", "<u4", "<u4", "<i8", "?", "<u8", "u1") for _, b in rows]
        edge = np.cumsum([0, *(len(b[1]) for b in blobs)])
        base, size, times, place, least, wide, deal, data = (np.concatenate(c) for c in zip(*blobs, strict=True))
        base = np.arange(edge[-1]) + np.repeat(base - edge[:-1], np.diff(edge))      # numbers in their shards
        del blobs, rows
        size, times = size.astype(np.int64), times.astype(np.int64)
        start = np.cumsum(size) - size
        order, new = same_texts(data, start, size, deal, length)
        head = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)         # of the distinct text
        number[order] = np.cumsum(new) - 1
        low, pick = np.minimum.reduceat(least[order], head), order[head]
        # equal windows have equal samples: the only context of a sample shares none; the others go to suffix arrays
        first = np.flatnonzero(np.concatenate([[True], deal[pick[1:]] != deal[pick[:-1]]]))
        n = np.diff(np.concatenate([first, [len(pick)]]))
        alone = first[n == 1]
        first, n = first[n > 1], n[n > 1]
        several = _spread(n, first)[1]
        ends = np.concatenate([[0], np.cumsum(n)])
        offsets = np.concatenate([[0], np.cumsum(size[pick[several]])])[ends]
        runs = [(alone, np.zeros(len(alone), np.int64), size[pick[alone]] - length, low[alone])]
        raw = data.tobytes()
        for i, j in pieces(offsets, BATCH):
            texts = several[ends[i]:ends[j]]
            at, sizes = start[pick[texts]], size[pick[texts]]
            body = b"".join([raw[a:b] for a, b in zip(at.tolist(), (at + sizes).tolist(), strict=True)])
            who, win, lows = window_owners(np.frombuffer(body, np.uint8), sizes, low[texts], length)
            # per text, runs of windows with one smallest id
            o = _stable(who.astype(np.int64) * 256 + win, 40)
            who, win, lows = who[o], win[o], lows[o]
            cut = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (lows[1:] != lows[:-1])]))
            runs.append((texts[who[cut]], win[cut], win[np.concatenate([cut[1:], [len(who)]]) - 1], lows[cut]))
        r_who, r_a, r_b, r_low = (np.concatenate(c) for c in zip(*runs, strict=True))
        o = np.argsort(r_who, kind="stable")
        r_who, r_a, r_b, r_low = r_who[o], r_a[o], r_b[o], r_low[o]
        first = np.searchsorted(r_who, np.arange(len(pick) + 1))
        # runs of each text sent, where an occurrence may have a larger id; then their places
        k, r = _spread(first[number + 1] - first[number], first[number])
        on = (r_low[r] < least[k]) | wide[k]
        k, r = k[on], r[on]
        hot = np.flatnonzero(times[k] == 0)
        hot_no, hot_low, hot_edge = base[k[hot]].astype(np.uint32), r_low[r[hot]], np.searchsorted(k[hot], edge).tolist()
        e, p = _spread(times[k], (np.cumsum(times) - times)[k])
        at = (place[p] + r_a[r[e]]).astype(np.uint32)
        far, low = (r_b - r_a + length).astype(np.uint8)[r[e]], r_low[r[e]]
        edge = np.searchsorted(k[e], edge)

        def out():
            yield from passed
            for shard, a, b, i, j in zip(shards, edge[:-1].tolist(), edge[1:].tolist(), hot_edge[:-1], hot_edge[1:], strict=True):
                if a < b:
                    yield shard, _ANSWER, None, None, None, _pack(at[a:b], far[a:b], low[a:b])
                if i < j:
                    yield shard, _HOT_ANSWER, None, None, None, _pack(hot_no[i:j], hot_low[i:j])
        return _side(out())

    def removed(_key, docs, side):
        """(input, removed mark of every byte) of a shard."""
        x = _Input(docs, side, length)
        cover = np.zeros(len(x.text) + 1, np.int32)

        def mark(at, far, low):
            on = low < x.ids[x.stay[np.searchsorted(x.offs, at, side="right") - 1]]
            np.add.at(cover, at[on], 1)
            np.add.at(cover, (at + far)[on], -1)
        for blob in x.blobs(_ANSWER):
            at, far, low = _unpack(blob, "<u4", "u1", "<i8")
            mark(at.astype(np.int64), far, low)
        for blob in x.blobs(_HOT_PLACES):
            step, number = _unsqueeze(blob, "<u4", "<u4")
            lows = np.full(int(number.max()) + 1, _LAST)
            for answer in x.blobs(_HOT_ANSWER):
                no, low = _unpack(answer, "<u4", "<i8")
                lows[no] = low
            mark(np.cumsum(step, dtype=np.int64), length, lows[number])
        return x, np.cumsum(cover[:-1], dtype=np.int32, out=cover[:-1]) > 0

    def report(key, docs, side):
        x, gone = removed(key, docs, side)
        n = len(x.ids)
        n_removed, n_spans, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        data, offs = x.text, x.offs
        for k, r in enumerate(x.stay.tolist()):
            g = gone[offs[k]:offs[k + 1]]
            n_removed[r] = g.sum()
            n_spans[r] = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
            sha[r] = hashlib.sha256(data[offs[k]:offs[k + 1]][~g].tobytes()).hexdigest()
        for r in np.flatnonzero(x.copy).tolist():
            n_removed[r], n_spans[r], sha[r] = x.size[r], 1, hashlib.sha256(b"").hexdigest()
        return pa.table({"doc_id": x.doc_id, "n_bytes": pa.array(x.size.astype(np.int64)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans),
                         "kept_sha256": pa.array(sha, pa.string())})

    def spans(key, docs, side):
        x, gone = removed(key, docs, side)
        doc, start, stop = [], [], []
        for k in range(len(x.ids)):
            if x.copy[k]:
                a, b = [0], [int(x.size[k])]
            else:
                s = int(np.searchsorted(x.stay, k))
                edge = np.diff(np.concatenate([[0], gone[x.offs[s]:x.offs[s + 1]].astype(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
            doc += [x.doc_id[k].as_py()] * len(a)
            start += a
            stop += b
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})

    return sampled, shared, sent, answered, report, spans


def _plan(size: int) -> tuple[int, int, int]:
    """(shards, ranges of contexts, ranges of samples) for so many bytes of text: many enough to be spread, few enough for their pairs."""
    least = max(8, min(SPREAD, -(-size // (2 << 20))))
    shards, ranges = max(least, -(-size // SHARD_BYTES)), max(least, -(-size // RANGE_BYTES))
    return shards, ranges, max(least, -(-ranges // WIDE))


def _run(docs: DataFrame, length: int, shards: int | None, ranges: int | None):
    """(documents by shard, side rows, tasks): all steps but the last, as one lazy plan whose text exchange is reused."""
    rows = only(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        shards, *ranges = _plan(size)
    else:
        ranges = [ranges or shards] * 2
    sampled, shared, sent, answered, report, spans = _tasks(length, *ranges)
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(shards)).cast("int"), "th": F.xxhash64("text")})
    keys = rows.select("shard", "id", "th", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n")).filter(F.col("n") >= length)
    first = keys.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    copies = keys.join(first, "sha").filter("id > first").select(        # new names for Spark: it is co-grouped with its source
        F.col("shard").alias("shard"), F.lit(_COPY).alias("kind"), F.col("id").alias("id"), F.col("th").alias("th"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("blob"))
    by_shard = rows.select("shard", "id", "th", "doc_id", "text").groupBy("shard")
    one = by_shard.cogroup(copies.groupBy("shard")).applyInArrow(sampled, _ROUTE)
    side = copies.unionByName(one.groupBy("part").applyInArrow(shared, _SIDE))
    two = by_shard.cogroup(side.groupBy("shard")).applyInArrow(sent, _ROUTE)
    return by_shard, copies.unionByName(two.groupBy("part").applyInArrow(answered, _SIDE)), report, spans


def dedup_report(docs: DataFrame, length: int = LENGTH, shards: int | None = None, ranges: int | None = None) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay)."""
    by_shard, side, report, _ = _run(docs, length, shards, ranges)
    return by_shard.cogroup(side.groupBy("shard")).applyInArrow(report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def removed_spans(docs: DataFrame, length: int = LENGTH, shards: int | None = None, ranges: int | None = None) -> DataFrame:
    """(doc_id, start, stop): the maximal removed runs as UTF-8 byte offsets."""
    by_shard, side, _, spans = _run(docs, length, shards, ranges)
    return by_shard.cogroup(side.groupBy("shard")).applyInArrow(spans, "doc_id bigint, start bigint, stop bigint")
