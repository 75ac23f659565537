"""Byte-level BPE by dynamic programming over prefixes.

Two tokens are compatible when BPE of their joined bytes gives just these two. A sequence is the BPE encoding of its bytes
exactly if its neighbours are compatible, and every byte prefix has one valid last token: the one token that ends there and is
compatible with the last token of the prefix before it. The table of these last tokens is all that is stored: walking back
through it gives the encoding, an append continues it, and an edit renews it from the piece before the edit to the first
common piece boundary after it.

Text is first split into pieces by the vocabulary's pattern. A chunk (white space and what follows it up to the next white
space) is always a whole number of pieces, so chunks are encoded apart and each distinct one once.
"""

from __future__ import annotations

import base64
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import binary_rows, bounded_batches, bytes_of, mix, powers, spans, steps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_INVERSE = pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Distinct chunks, and pieces, that a generation of a worker's memory holds; there are two, and the older one is dropped.
REMEMBERED = 250_000
STEP = 1 << 21


class Memory:
    """A dictionary of bounded size: what was used of late stays."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def white_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to a white-space character."""
    out = _SPACE[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        b = np.append(raw, np.zeros(2, np.uint8))
        one, two, three = raw[lead], b[lead + 1], b[lead + 2]
        pair = lead[(one == 0xC2) & ((two == 0x85) | (two == 0xA0))]
        triple = lead[
            ((one == 0xE1) & (two == 0x9A) & (three == 0x80))
            | ((one == 0xE2) & (two == 0x80) & (((three >= 0x80) & (three <= 0x8A)) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)))
            | ((one == 0xE2) & (two == 0x81) & (three == 0x9F))
            | ((one == 0xE3) & (two == 0x80) & (three == 0x80))
        ]
        for k in range(2):
            out[pair + k] = True
        for k in range(3):
            out[triple + k] = True
    return out


class Bpe:
    """A vocabulary of byte strings by rank (lines of base64 token and rank), and what was learned of it so far."""

    def __init__(self, lines: bytes, pattern: str = PIECES):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(pattern)
        self.together: dict[int, bool] = {}
        self.pieces, self.chunks = Memory(), Memory()
        self.ends = ahocorasick.Automaton()
        for k, v in self.rank.items():
            self.ends.add_word(k.decode("latin-1"), (v, len(k)))
        self.ends.make_automaton()
        size = max(self.bytes) + 1
        self.length = np.zeros(size, np.int64)
        for k, v in self.bytes.items():
            self.length[k] = len(v)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.bytes.get(k, b"") for k in range(size)), np.uint8)

    def merge(self, s: bytes) -> list[int]:
        """BPE from its definition: the adjacent pair of least rank is joined until none can be."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.together.get(key)
        if ok is None:
            if len(self.together) > 8 * REMEMBERED:
                self.together.clear()
            ok = self.together[key] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return ok

    def last_tokens(self, s: bytes) -> list[int]:
        """By byte prefix of a piece (of 1, 2, ... bytes) its valid last token."""
        last: list[int] = []
        together = self.together.get
        for end, (t, size) in self.ends.iter(s.decode("latin-1")):
            if end < len(last):
                continue  # it has its token
            if end > len(last):
                break
            j = end + 1 - size
            if j:
                a = last[j - 1]
                ok = together(a << 32 | t)
                if ok is None:
                    ok = self.compatible(a, t)
            else:
                ok = self.whole(t)
            if ok:
                last.append(t)
        if len(last) < len(s):
            raise ValueError(f"the vocabulary lacks byte {s[len(last)]}")
        return last

    def whole(self, t: int) -> bool:
        """Whether a token's bytes encode as that token."""
        key = -1 - t
        ok = self.together.get(key)
        if ok is None:
            ok = self.together[key] = self.merge(self.bytes[t]) == [t]
        return ok

    def walk(self, last, end: int | None = None) -> list[int]:
        """The encoding of a prefix from the table of last tokens."""
        out, i = [], len(last) if end is None else end
        while i > 0:
            t = int(last[i - 1])
            out.append(t)
            i -= int(self.length[t])
        return out[::-1]

    def piece(self, s: bytes) -> tuple[tuple[int, ...], bytes]:
        """(tokens, table of last tokens) of a piece."""
        found = self.pieces.get(s)
        if found is None:
            last = self.last_tokens(s)
            found = self.pieces.put(s, (tuple(self._ending(last)), np.array(last, np.int32).tobytes()))
        return found

    def _ending(self, last: list[int]) -> list[int]:
        out, i, data = [], len(last), self.bytes
        while i > 0:
            t = last[i - 1]
            out.append(t)
            i -= len(data[t])
        return out[::-1]

    def chunk(self, s: bytes) -> tuple[tuple[int, ...], bytes]:
        """(tokens, table of last tokens) of a chunk."""
        found = self.chunks.get(s)
        if found is None:
            text = s.decode()
            if text[1:].isalpha() and text[0] == " " or text.isalpha():
                found = self.piece(s)
            else:
                parts = [self.piece(p.encode()) for p in self.split.findall(text)]
                found = tuple(chain.from_iterable(t for t, _ in parts)), b"".join(x for _, x in parts)
            self.chunks.put(s, found)
        return found

    def encode_step(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all documents of a step, their offsets by document, last token of every byte prefix)."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int32)
        space = white_space(raw)
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[offsets < n]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
        h = mix((total[end] - total[begin]) * powers(n, _INVERSE)[begin]) ^ (end - begin).astype(np.uint64)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        data = raw.tobytes()
        get, chunk = self.chunks.new.get, self.chunk
        lists = [get(c) or chunk(c) for c in [data[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]]
        many = np.fromiter((len(t) for t, _ in lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(t for t, _ in lists), np.int32, int(many.sum()))
        ends = np.cumsum(many)
        tokens = flat[spans((ends - many)[inverse], ends[inverse])]
        upto = np.append(0, np.cumsum(many[inverse]))
        # a chunk has an entry for each of its bytes, so documents' tables lie where their bytes do
        tables = np.frombuffer(b"".join(x for _, x in lists), np.int32)
        size = (end - begin)[at]
        ends = np.cumsum(size)
        return tokens, upto[np.searchsorted(begin, offsets)], tables[spans((ends - size)[inverse], ends[inverse])]

    def decode_flat(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        return self.data[spans(self.start[tokens], self.start[tokens] + self.length[tokens])]

    # -- the stored table ---------------------------------------------------------------------------------------------

    def _chunks_of(self, data: bytes, at: int) -> list[int]:
        """Starts of chunks from a chunk's start on, and the end."""
        space = white_space(np.frombuffer(data[at:], np.uint8))
        first = space.copy()
        first[1:] &= ~space[:-1]
        if len(first):
            first[0] = True
        return [*(np.flatnonzero(first) + at).tolist(), len(data)]

    def _table(self, data: bytes, a: int, b: int) -> list[int]:
        return list(chain.from_iterable(self.last_tokens(p.encode()) for p in self.split.findall(data[a:b].decode())))

    def prefixes(self, data: bytes) -> np.ndarray:
        """The last token of every byte prefix of a UTF-8 text (int32)."""
        cuts = self._chunks_of(data, 0)
        return np.array([t for a, b in zip(cuts, cuts[1:]) for t in self._table(data, a, b)], np.int32)

    def edit(self, last: np.ndarray, data: bytes, at: int, removed: int, inserted: bytes) -> tuple[np.ndarray, bytes, int]:
        """(table, text, bytes encoded anew) after the bytes at:at+removed give way to others; equal to ``prefixes`` of the new text."""
        new = data[:at] + inserted + data[at + removed :]
        space = white_space(np.frombuffer(data[:at], np.uint8))
        starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if at else np.zeros(0, np.int64)
        restart = int(starts[-1]) if len(starts) else 0
        old = set(self._chunks_of(data, restart))
        shift = len(inserted) - removed
        out: list[int] = []
        cuts = self._chunks_of(new, restart)
        for a, b in zip(cuts, cuts[1:]):
            if a > restart and a >= at + len(inserted) + 1 and a - shift in old:
                return np.concatenate([last[:restart], np.array(out, np.int32), last[a - shift :]]).astype(np.int32), new, a - restart
            out += self._table(new, a, b)
        return np.concatenate([last[:restart], np.array(out, np.int32)]).astype(np.int32), new, len(new) - restart

    def append(self, last: np.ndarray, data: bytes, more: bytes) -> tuple[np.ndarray, bytes, int]:
        """``edit`` at the end."""
        return self.edit(last, data, len(data), 0, more)


_loaded: dict[int, Bpe] = {}


def _bpe(lines: bytes) -> Bpe:
    """One per worker and vocabulary; what it learned stays from task to task."""
    key = hash(lines)
    if key not in _loaded:
        _loaded[key] = Bpe(lines)
    return _loaded[key]


def vocabulary(path: str = VOCABULARY) -> bytes:
    """A vocabulary file, read by the driver; its size doesn't depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def _list_of_int32(values: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(mask) if mask.any() else None)


def _encoded(bpe: Bpe, column: pa.Array) -> pa.StructArray:
    tokens, ends, exact, last = [], [np.zeros(1, np.int64)], [], [pa.array([], pa.binary())]
    done = 0
    for _, _, raw, offsets in steps(column, STEP):
        t, o, table = bpe.encode_step(raw, offsets)
        last.append(binary_rows(table, offsets))
        tokens.append(t)
        ends.append(o[1:] + done)
        done += len(t)
        back = bpe.decode_flat(t)
        size = np.append(0, np.cumsum(bpe.length[t]))[o]
        if len(back) == len(raw) and (size == offsets).all():
            wrong = np.append(0, np.cumsum(back != raw))[offsets]
            exact.append(wrong[1:] == wrong[:-1])
        else:
            exact.append(np.array([back[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(size, size[1:], offsets, offsets[1:])]))
    none = np.array(column.is_null())
    at = np.concatenate(ends)
    tables = last[1] if len(last) == 2 else pa.concat_arrays(last)
    if none.any():
        tables = pc.if_else(pa.array(none), pa.scalar(None, pa.binary()), tables)
    return pa.StructArray.from_arrays([_list_of_int32(np.concatenate(tokens) if tokens else np.zeros(0, np.int32), at, none), pa.array(np.concatenate(exact) if exact else np.zeros(0, bool), pa.bool_(), mask=none), tables], ["tokens", "exact", "last"])


def encode_column(text: Column, lines) -> Column:
    """struct(tokens, exact, last): the encoding, whether decoding gives the very bytes back, and the table of last tokens (int32 by
    byte prefix, as binary). lines: a broadcast vocabulary."""

    @arrow_udf("struct<tokens: array<int>, exact: boolean, last: binary>")
    def encode(column: pa.Array) -> pa.Array:
        return _encoded(_bpe(lines.value), column)

    return encode(text)


def decode_column(tokens: Column, lines) -> Column:
    """The text of an array of tokens; null for a null array, an unknown or null token, or bytes that aren't UTF-8."""

    @arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        bpe = _bpe(lines.value)
        out = []
        for row in column.to_pylist():
            try:
                out.append(None if row is None else b"".join(bpe.bytes[t] for t in row).decode())
            except (KeyError, UnicodeDecodeError):
                out.append(None)
        return pa.array(out, pa.string())

    return decode(tokens)


def prefix_column(text: Column, lines) -> Column:
    """The table of last tokens, int32 by byte prefix, as binary."""

    @arrow_udf("binary")
    def prefixes(column: pa.Array) -> pa.Array:
        bpe = _bpe(lines.value)
        return pa.array([None if t is None else bpe.prefixes(t.encode()).tobytes() for t in column.to_pylist()], pa.binary())

    return prefixes(text)


def append_column(text: Column, table: Column, more: Column, lines) -> Column:
    """The table of text + more from that of text; null if one of the three is null."""

    @arrow_udf("binary")
    def append(texts: pa.Array, tables: pa.Array, mores: pa.Array) -> pa.Array:
        bpe = _bpe(lines.value)
        return pa.array([None if t is None or p is None or m is None else bpe.append(np.frombuffer(p, np.int32), t.encode(), m.encode())[0].tobytes() for t, p, m in zip(texts.to_pylist(), tables.to_pylist(), mores.to_pylist())], pa.binary())

    return append(text, table, more)


def edit_column(text: Column, table: Column, at: Column, removed: Column, inserted: Column, lines) -> Column:
    """The table after ``removed`` characters from character ``at`` (from 0) give way to others; null if one of the five is null."""

    @arrow_udf("binary")
    def edit(*columns: pa.Array) -> pa.Array:
        bpe, out = _bpe(lines.value), []
        for t, p, a, n, new in zip(*(c.to_pylist() for c in columns)):
            if t is None or p is None or a is None or n is None or new is None:
                out.append(None)
                continue
            before, gone = t[:a].encode(), t[a : a + n].encode()
            out.append(bpe.edit(np.frombuffer(p, np.int32), t.encode(), len(before), len(gone), new.encode())[0].tobytes())
        return pa.array(out, pa.binary())

    return edit(text, table, at.cast("long"), removed.cast("long"), inserted)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact, last) for every row; exact: decoding the tokens gives the text's bytes; last: the last token of
    every byte prefix (int32, as binary), from which the tokens are walked back and which ``append_column`` and ``edit_column`` go on from.

    A null text has null in all four; an empty one has no tokens. Repeated rows and null ids are encoded like any other.
    Other columns are not read. Texts of any length are encoded whole; only distinct chunks cost more than a look-up.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):
        # the tables are four times the text, so a batch is handed on step by step
        for b in batches:
            for lo, hi, _, _ in steps(b.column(1), STEP):
                e = _encoded(_bpe(lines.value), b.column(1).slice(lo, hi - lo))
                tokens, exact, last = e.flatten()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), tokens, pc.list_value_length(tokens), exact, last], ["doc_id", "tokens", "n_tokens", "exact", "last"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens array<int>, n_tokens int, exact boolean, last binary")
