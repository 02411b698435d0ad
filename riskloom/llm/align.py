"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Side A is a byte-level BPE of the ``tokenizers`` library over space + text, side B a ``sentencepiece`` model over the text (it adds
the space itself).  In each batch ``pandas.merge_asof``, keyed by document, finds for every token start the other side's token
that covers it; the union of both directions holds every overlapping pair, those that end together are links, and their ends cut
both sequences into groups.

Corpus-wide link counts of id pairs: the links of a block of documents are kept as one row, places in the block's own list of
distinct pairs; a block adds one row a pair to the counts, and gets the pairs' totals back the same way.  So what is shuffled is
a row a block and distinct pair, never a row a link, and a pair that is in every text is one row a block.

Tokens are found by parts that neither side can merge across: a text is cut before each space that follows a character other than
white space (there A's pre-tokeniser cuts too, and no piece of B has a space behind another character), and each distinct part is
encoded once by the libraries.  Where that isn't certain (characters outside ``STEADY``, a normaliser that changes the text, a space at
the end) the libraries encode the whole text.

Edge cases: null and empty texts, texts that aren't valid UTF-8 and texts whose tokens' bytes differ from space + text have no
tokens: zeros and ''; rows that repeat a doc_id, or have none, are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only, text_buffers, text_pieces

#: fixed values: the pre-tokeniser's split pattern of byte-level BPE, its letters, numbers and spaces to be filled in
PARTS_A = "'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
#: code points whose letter, number and space properties all versions of the regex libraries agree on
STEADY = r"\x00-\x1b\x20-\x84\x86-ɏΑ-ΡΣ-ώА-я‐-‧ぁ-ゔァ-ヺ一-龥가-힣"
PARTS = r" *(?:\S+|[^\S ]+ *)+"
SPACE = "▁"           # a space in a piece
MAX_PARTS = 600_000        # distinct parts a worker remembers
BLOCK_LINKS = 4_000_000    # links of a block, unless a single text has more
PIECE = 1 << 20            # bytes of text aligned at once, unless a single text has more


class Vocabulary:
    """Bytes of each token id, side by side."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.begin[ids], self.size[ids])]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[k] .. begin[k] + size[k] - 1 for each k, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@functools.cache
def _letters() -> dict[int, str]:
    """Byte-level letters: the printable characters of Latin-1 stand for themselves, the other bytes for 256, 257 ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}


@functools.cache
def _side_a(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"         # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True                         # their strings are plain text
    letters = {c: b for b, c in _letters().items()}
    special = {k for k, v in t.get_added_tokens_decoder().items() if v.special}
    entries = [b""] * t.get_vocab_size()
    for text, k in t.get_vocab().items():
        entries[k] = text.encode() if k in special else bytes(letters[c] for c in text)
    by_parts = t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel)
    return t, Vocabulary(entries), by_parts


@functools.cache
def _side_b(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(k) for k in range(n)]
    entries = [bytes([int(p[3:-1], 16)]) if m.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
    by_parts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    return m, Vocabulary(entries), by_parts


def _class(property_: str) -> str:
    """The steady characters of a property, as the inside of a character class."""
    on = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and _STEADY.fullmatch(chr(c)) and regex.fullmatch(property_, chr(c))]
    first = [c for k, c in enumerate(on) if k == 0 or c != on[k - 1] + 1]
    last = [c for k, c in enumerate(on) if k == len(on) - 1 or c != on[k + 1] - 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))


_STEADY = re.compile(f"[{STEADY}]*")


@functools.cache
def _parts_a() -> re.Pattern:
    return re.compile(PARTS_A.format(letters=_class(r"\p{L}"), numbers=_class(r"\p{N}"), spaces=_class(r"\s")))


_PARTS = re.compile(PARTS)


class Memory:
    """The parts of texts met so far, with their ids on both sides."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _side_a(path_a), _side_b(path_b)
        self.pair = Remembered(), Remembered()
        self.place: dict[str, int] = {}

    def encoded(self, texts_parts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if len(self.place) > MAX_PARTS:
            self.place.clear()
            self.pair = Remembered(), Remembered()
        parts = list(itertools.chain.from_iterable(texts_parts))
        at = np.fromiter(map(self.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(parts[k] for k in missing))
            n = len(self.place)
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            self.pair[0].add(_encode_parts(self.a[0], [_parts_a().findall(p) for p in new]))
            self.pair[1].add(self.b[0].encode([p[1:] for p in new], num_threads=1))       # every part begins with a space: the one that the model adds
            at[missing] = [self.place[parts[k]] for k in missing]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in texts_parts])]).astype(np.int64)
        return self.pair[0].of(at, edge), self.pair[1].of(at, edge)


class Remembered:
    """Ids of parts, side by side, in the order in which they were added."""

    def __init__(self):
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, got) -> None:
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in got])])

    def of(self, at: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
        """The ids of the parts ``at``, cut into texts at ``edge``."""
        size = self.first[at + 1] - self.first[at]
        flat = self.ids[_ranges(self.first[at], size)]
        to = np.concatenate([[0], np.cumsum(size)])[edge]
        return [flat[x:y] for x, y in itertools.pairwise(to)]


@functools.cache
def _memory(path_a: str, path_b: str) -> Memory:
    return Memory(path_a, path_b)


def tokens(path_a: str, path_b: str, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A's ids of space + text and B's ids of text."""
    (t, _, parts_a), (m, _, parts_b) = _side_a(path_a), _side_b(path_b)
    known = [parts_a and parts_b and x != "" and not x.endswith(" ") and _STEADY.fullmatch(x) is not None
             and m.normalize(x) == SPACE + x.replace(" ", SPACE) for x in texts]
    got_a, got_b = map(iter, _memory(path_a, path_b).encoded([_PARTS.findall(" " + x) for x, k in zip(texts, known, strict=True) if k]))
    rest = iter(_encode_a(t, [" " + x for x, k in zip(texts, known, strict=True) if not k]))
    ids_a = [next(got_a) if k else np.array(next(rest), np.int32) for k in known]
    return ids_a, [next(got_b) if k else np.array(m.encode(x), np.int32) for x, k in zip(texts, known, strict=True)]


def _encode_parts(t, parts: list[list[str]]) -> list[list[int]]:
    """A's ids of parts that its pre-tokeniser has cut already: the model alone, over byte-level letters."""
    letters, tokenize = _letters(), t.model.tokenize
    return [[x.id for p in pieces for x in tokenize(p.encode().decode("latin-1").translate(letters))] for pieces in parts]


def _encode_a(t, texts):
    return [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _table(ids: list[np.ndarray], vocabulary: Vocabulary, base: np.ndarray) -> pd.DataFrame:
    """Tokens of all texts in order: document, byte range (counted over the whole batch) and id."""
    count = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    size = vocabulary.size[flat]
    doc = np.repeat(np.arange(len(ids)), count)
    before = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count) - count]
    start = np.cumsum(size) - size - before[doc] + base[doc]
    return pd.DataFrame({"doc": doc, "start": start, "end": start + size, "id": flat, "at": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """(pairs, 2) places of all overlapping tokens: each start's covering token, from both sides."""
    cover_a = pd.merge_asof(a[["doc", "start", "at"]], b[["doc", "start", "at"]], on="start", by="doc", suffixes=("_a", "_b"))
    cover_b = pd.merge_asof(b[["doc", "start", "at"]], a[["doc", "start", "at"]], on="start", by="doc", suffixes=("_b", "_a"))
    # tokens that begin together are found from both sides: the second finding is left out
    once = b["start"].to_numpy()[cover_b["at_b"]] != a["start"].to_numpy()[cover_b["at_a"]]
    return np.concatenate([cover_a[["at_a", "at_b"]].to_numpy(np.int64), cover_b[["at_a", "at_b"]].to_numpy(np.int64)[once]])


_DIGITS = 8                # characters of an id with the separator before it


@functools.cache
def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``n`` as 8 characters in one word each (a place for the separator, the digits, zeros), and how many are used."""
    texts = np.array([f"?{k}" for k in range(n)], f"S{_DIGITS}")
    return texts.view("<u8"), np.char.str_len(texts)


def group_texts(a: pd.DataFrame, b: pd.DataFrame, links: np.ndarray, n_docs: int) -> list[bytes]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
    # a token's group: the links that ended before it
    ends = np.zeros(len(a) + 1, np.int64)
    ends[links[:, 0] + 1] = 1
    group_a = np.cumsum(ends)[:-1]
    ends = np.zeros(len(b) + 1, np.int64)
    ends[links[:, 1] + 1] = 1
    group_b = np.cumsum(ends)[:-1]
    doc = np.concatenate([a["doc"], b["doc"]])
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side, doc = np.concatenate([a["id"], b["id"]])[order], group[order], side[order], doc[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    turn = np.concatenate([[True], side[1:] != side[:-1]])
    head = np.concatenate([[True], doc[1:] != doc[:-1]])
    words, used = _decimal(1 << int(ids.max()).bit_length())
    chars = words[ids].view(np.uint8).reshape(-1, _DIGITS)
    chars[:, 0] = np.where(head, 0, np.where(new, ord(";"), np.where(turn, ord("|"), ord(","))))
    edge = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=used[ids] - head, minlength=n_docs).astype(np.int64))])
    flat = chars[chars != 0].tobytes()
    return [flat[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]


def _spells(ids: list[np.ndarray], vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts whose tokens' joined bytes are a space and the text's bytes."""
    flat = np.concatenate(ids)
    edge = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(vocabulary.size[flat])])[edge]
    n = np.diff(offsets)
    out = np.diff(upto) == n + 1
    got = vocabulary.bytes_of(flat)
    out &= got[np.minimum(upto[:-1], max(len(got) - 1, 0))] == 32 if len(got) else False
    on = np.flatnonzero(out & (n > 0))
    same = got[_ranges(upto[on] + 1, n[on])] == data[_ranges(offsets[on], n[on])]
    wrong = np.concatenate([[0], np.cumsum(~same)])
    to = np.cumsum(n[on])
    out[on] &= wrong[to] == wrong[to - n[on]]
    return out


def align(data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
    """(n_a, n_b, n_links, digests, link documents, link pairs) of a piece; a pair is A's id * 2^32 + B's id."""
    n = len(offsets) - 1
    texts = []
    for x, y in zip(offsets[:-1], offsets[1:], strict=True):
        try:
            texts.append(data[x:y].tobytes().decode())
        except UnicodeDecodeError:
            texts.append("")
    va, vb = _side_a(path_a)[1], _side_b(path_b)[1]
    ids_a, ids_b = tokens(path_a, path_b, texts)
    sound = np.diff(offsets) > 0
    for ids, vocabulary in ((ids_a, va), (ids_b, vb)):
        sound &= _spells(ids, vocabulary, data, offsets)
    for k in np.flatnonzero(~sound):
        ids_a[k] = ids_b[k] = np.zeros(0, np.int32)
    base = offsets[:-1] + np.arange(n)                     # a space more for each text
    a, b = _table(ids_a, va, base), _table(ids_b, vb, base)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    if not len(a):
        z = np.zeros(0, np.int64)
        return n_a, n_b, np.zeros(n, np.int64), [""] * n, z, z
    pairs = overlaps(a, b)
    links = pairs[a["end"].to_numpy()[pairs[:, 0]] == b["end"].to_numpy()[pairs[:, 1]]]
    links = links[np.argsort(links[:, 0], kind="stable")]
    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in group_texts(a, b, links, n)]
    doc = a["doc"].to_numpy()[links[:, 0]]
    code = a["id"].to_numpy(np.int64)[links[:, 0]] << 32 | b["id"].to_numpy(np.int64)[links[:, 1]]
    return n_a, n_b, np.bincount(doc, minlength=n), digests, doc, code


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _block(parts: list, links: list) -> dict:
    """One row of a block: its documents, their links as places in the block's distinct pairs, these pairs and their counts."""
    docs = pa.Table.from_batches(parts, _DOCS)
    pair, at, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
    at = at.astype(np.int32)
    return {"docs": _packed(docs), "links": _packed(pa.table({"at": at})), "pairs": pair, "n": n.astype(np.int64)}


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, docs, links, pairs, n): all documents, aligned, in blocks of bounded size."""
    out = pa.schema([("docs", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def run(batches):
        gc.set_threshold(200_000)                          # millions of strings and no cycles: seldom worth a look
        parts, links, size = [], [], 0

        def done():
            got = _block(parts, links)
            return pa.record_batch([pa.array([got["docs"]]), pa.array([got["links"]]), pa.array([got["pairs"]], pa.list_(pa.int64())),
                                    pa.array([got["n"]], pa.list_(pa.int64()))], schema=out)

        for batch in batches:
            for x, y, data, offsets in text_pieces(batch.column("text"), PIECE):
                n_a, n_b, n_links, digests, _, code = align(data, offsets, path_a, path_b)
                parts.append(pa.record_batch([batch.column("doc_id").slice(x, y - x), pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(digests)], schema=_DOCS))
                links.append(code)
                size += len(code)
                if size >= BLOCK_LINKS:
                    yield done()
                    parts, links, size = [], [], 0
        if parts:
            yield done()

    rows = only(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(run, "docs binary, links binary, pairs array<bigint>, n array<bigint>").withColumn("block", F.monotonically_increasing_id())


def pair_counts(block_rows: DataFrame) -> DataFrame:
    """(of, at, count, best): for each distinct pair of a block its corpus-wide links, and whether no pair of its B id has more."""
    seen = block_rows.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "x")).select("of", "at", F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    total = cut_lineage(seen.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = total.groupBy(b.alias("b")).agg(F.max("count").alias("most"))                  # a row a B id: bounded by the vocabulary
    total = total.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return seen.select("of", "at", "pair").join(total, "pair").select("of", "at", "count", "best")


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = cut_lineage(blocks(docs, path_a, path_b))
    counts = pair_counts(rows)
    out = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def run(_key, left, right):
        if not left.num_rows:
            return out.empty_table()
        count = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, np.int64)
        at = right.column("at").to_numpy()
        count[at] = right.column("count").to_numpy()
        best[at] = right.column("best").to_numpy().astype(np.int64)
        got = pa.ipc.open_stream(left.column("docs")[0].as_buffer()).read_all()
        links = pa.ipc.open_stream(left.column("links")[0].as_buffer()).read_all().column("at").to_numpy()
        n = got.column("n_links").to_numpy()
        edge = np.concatenate([[0], np.cumsum(n)])
        sums = []
        for x in (best, count):
            run_up = np.concatenate([[0], np.cumsum(x[links])])
            sums.append(pa.array(run_up[edge[1:]] - run_up[edge[:-1]]))
        d = {c: got.column(c) for c in got.schema.names}
        return pa.table([d["doc_id"], d["n_a"], d["n_b"], d["n_links"], d["n_links"], *sums, d["groups_sha256"]], schema=out)

    return (rows.select("block", "docs", "links").groupBy("block").cogroup(counts.groupBy("of"))
            .applyInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"))
