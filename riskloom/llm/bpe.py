"""BPE encoding and decoding as a streaming transducer over a tokenizer file's merge list.

Two facts about merge lists make streaming possible: a sequence of tokens is the BPE of its string if and
only if every adjacent pair is the BPE of its own string, and so each prefix's last token follows from the
last tokens of shorter prefixes.  The transducer keeps, behind the last stable token, the symbols that a
later token may still reach (a token's proper prefix: the merge list's sufficient lookahead is its longest
token less one) plus those whose token chains have not met yet, and emits a token once every chain that can
go on contains it.  Which pairs may stand in a row, and the ids of frequent words, are kept in tables that are
emptied at their bounds, so memory doesn't grow with the text.

Edge cases: null text is empty; an empty text has no tokens; special tokens' strings in a text are those
tokens, as in the library; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

MAX_WORDS = 250_000        # in each of the two generations of the word table
MAX_PAIRS = 1_000_000
_END = 0x10000             # added to the code point of a word's last symbol


def byte_symbols() -> dict[int, str]:
    """The printable character of each byte in byte-level BPE files (fixed by their format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeTransducer:
    """Symbols in, token ids out, for the merge list of a ``tokenizers`` BPE model with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix

        def symbols(token):
            """A token as a string with one character a symbol."""
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                body = token[:-len(suffix)]
                return body[:-1] + chr(ord(body[-1]) + _END)
            return token

        self.rank: dict[int, int] = {}             # pair of ids -> rank of its merge
        self.parts: dict[int, tuple] = {}          # id -> (rank of the merge that makes it, left id, right id)
        made = {}
        for k, (a, b) in enumerate(merges):
            joined = vocab.get(a + b)
            pair = vocab[a] << 32 | vocab[b]
            if joined is not None and pair not in self.rank:
                self.rank[pair] = k
                made[pair] = joined
                self.parts.setdefault(joined, (k, vocab[a], vocab[b]))
        self.made = made
        self.pairs: dict[int, bool] = {}
        text = {i: symbols(t) for t, i in vocab.items()}
        self.token = {t: i for i, t in text.items() if len(t) == 1}
        # a longer token counts if BPE makes it from its own string
        self.token |= {t: i for i, t in text.items() if len(t) > 1 and i in self.parts and self.plain(t) == [i]}
        # strings that begin a token -> the token's id, or -1
        self.nodes = {t[:k]: -1 for t in self.token for k in range(1, len(t))} | self.token
        self.prefixes = {t[:k] for t in self.token for k in range(1, len(t))}
        self.longest = max(map(len, self.token), default=1)
        self.lookahead = self.longest - 1
        self.reset()

    def plain(self, symbols: str) -> list[int]:
        """BPE by its definition: always the lowest-ranked pair, leftmost first."""
        ids = [self.token[c] for c in symbols]
        while len(ids) > 1:
            rank, k = min((self.rank.get(a << 32 | b, 1 << 40), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 40:
                break
            ids[k:k + 2] = [self.made[ids[k] << 32 | ids[k + 1]]]
        return ids

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b in a row are the BPE of their string.

        Undo the merges of both, the latest first: at no moment may the two symbols that face each other
        have had a merge of a lower rank than the merge that then took one of them away.  (At equal rank, the merge
        further left comes first.)
        """
        rank, parts, limit = self.rank, self.parts, 1 << 40
        while True:
            across = rank.get(a << 32 | b)
            if across is not None and across < limit:
                return False
            ra, rb = parts.get(a, (-1,))[0], parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][2]
            else:
                limit, b = rb + 1, parts[b][1]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._fits(a, b)
        return got

    def reset(self):
        self.prev, self.pending, self.last, self.alive = -1, "", [None], []

    def feed(self, symbols: str) -> list[int]:
        """Take symbols of a word; return the tokens that no continuation can change any more."""
        self.pending += symbols
        pending, last, prev = self.pending, self.last, self.prev
        node, pairs, alive = self.nodes.get, self.pairs.get, self.alive
        for n in range(len(last), len(pending) + 1):
            alive.append(n - 1)
            here, still = None, []
            for j in alive:                            # starts from which a token's prefix runs up to n
                t = node(pending[j:n])
                if t is None:
                    continue
                still.append(j)
                if t >= 0 and here is None:
                    before = last[j][1] if j else prev
                    if before == -1:
                        here = (j, t)
                    elif before >= 0:
                        ok = pairs(before << 32 | t)
                        if ok or (ok is None and self.fits(before, t)):
                            here = (j, t)
            if here is None:
                raise ValueError(f"no token ends the symbols {pending[:n]!r}")
            last.append(here)
            alive = still
        self.alive = alive
        return self._emit() if len(pending) > 2 * self.longest else []

    def _chain(self, n: int) -> list:
        """(end, token) of the tokens of the first n pending symbols, last first."""
        out = []
        while n > 0:
            j, t = self.last[n]
            out.append((n, t))
            n = j
        return out

    def _emit(self) -> list[int]:
        n, pending = len(self.pending), self.pending
        chain = self._chain(n)
        common = {e for e, _ in chain}
        for j in self.alive:
            if pending[j:] in self.prefixes:           # a later token may begin at j
                common &= {e for e, _ in self._chain(j)}
        cut = max(common, default=0)
        if not cut:
            return []
        out = [t for e, t in reversed(chain) if e <= cut]
        self.prev, self.pending = out[-1], pending[cut:]
        # a prefix whose last token began before the cut can't be on a chain any more
        self.last = [None, *[(j - cut, t) if j >= cut else (0, -2) for j, t in self.last[cut + 1:]]]
        self.alive = [j - cut for j in self.alive if j >= cut]
        return out

    def finish(self) -> list[int]:
        out = [t for _, t in reversed(self._chain(len(self.pending)))]
        self.reset()
        return out

    def word(self, symbols: str) -> list[int]:
        """Token ids of one word (its last symbol marked), fed in bounded blocks."""
        if len(symbols) <= 64:
            self.feed(symbols)
            return self.finish()
        out = []
        for k in range(0, len(symbols), 64):
            out += self.feed(symbols[k:k + 64])
        return out + self.finish()


class Encoder:
    """Text to token ids, as the ``tokenizers`` library encodes without added specials."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = MergeTransducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.symbol = {chr(b): s for b, s in byte_symbols().items()}
        self.bytes = str.maketrans(self.symbol)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:                            # the library lower-cases sigma without regard to its place
            text = text.replace("Σ", "σ")
        return text.lower()

    def piece(self, word: str) -> bytes:
        """Packed ids of one pre-token."""
        marks = word.encode("utf-8").decode("latin-1").translate(self.bytes)
        if self.machine.suffix:
            marks = marks[:-1] + chr(ord(marks[-1]) + _END)
        ids = self.machine.word(marks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def stream(self, text: str):
        """Packed ids of the pre-tokens, one after the other."""
        words = self.words
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield struct.pack("<I", self.special[part])
                continue
            for w in self.find(self.normal(part)):
                got = words.get(w)
                if got is None:
                    got = self.older.get(w) or self.piece(w)
                    if len(w) <= 64:
                        if len(words) >= MAX_WORDS:
                            self.older, self.words = words, {}
                            words = self.words
                        words[w] = got
                yield got

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text)), "<u4")


class Decoder:
    """Token ids to text, piece by piece.

    ``library`` joins the tokens' own strings with spaces, as the library does for a file without
    a decoder; else the state machine turns tokens into bytes, a word end into a space, and holds back an unfinished
    UTF-8 sequence until its bytes come (invalid bytes become U+FFFD).
    """

    def __init__(self, path: str, library: bool = True):
        import codecs

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = {t["id"] for t in spec.get("added_tokens") or []}
        self.library, self.suffix = library, spec["model"].get("end_of_word_suffix") or ""
        size = max(vocab.values()) + 1
        self.string = [""] * size
        for t, i in vocab.items():
            self.string[i] = t
        back = {s: b for b, s in byte_symbols().items()}

        def raw(i, t):
            if i in self.special:
                return t.encode()
            end = bool(self.suffix) and t.endswith(self.suffix)
            return bytes(back[c] for c in (t[:-len(self.suffix)] if end else t)) + b" " * end

        self.table = self.string if library else [raw(i, t) for i, t in enumerate(self.string)]
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def reset(self):
        self.utf8.reset()
        self.begun = False

    def feed(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if self.library:
            out = " ".join([self.table[i] for i in ids])
            if ids and self.begun:
                out = " " + out
            self.begun |= bool(ids)
            return out
        return self.utf8.decode(b"".join([self.table[i] for i in ids]))

    def finish(self) -> str:
        out = "" if self.library else self.utf8.decode(b"", True)
        self.reset()
        return out


_LOADED: dict = {}
CHUNK = 1 << 16            # ids decoded at a time


def _loaded(path: str):
    """The worker process's encoder and decoder of a file (its tables are bounded)."""
    if path not in _LOADED:
        _LOADED[path] = (Encoder(path), Decoder(path))
    return _LOADED[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, sha256 of the little-endian ids, sha256 of the decoded text."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc, dec = _loaded(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                a, b, count = hashlib.sha256(), hashlib.sha256(), 0
                dec.reset()
                held, size = [], 0
                for packed in enc.stream(text):
                    held.append(packed)
                    size += len(packed)
                    if size >= 4 * CHUNK:
                        block = b"".join(held)
                        a.update(block)
                        b.update(dec.feed(np.frombuffer(block, "<u4")).encode())
                        count += size // 4
                        held, size = [], 0
                block = b"".join(held)
                a.update(block)
                b.update((dec.feed(np.frombuffer(block, "<u4")) + dec.finish()).encode())
                n.append(count + size // 4)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` columns doc_id, token ids and the text that they decode to."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        enc, dec = _loaded(path)
        for batch in batches:
            ids = [enc.encode(t.as_py() or "").astype(np.int32) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([dec.feed(x) + dec.finish() for x in ids], pa.string())], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
