"""Byte-level BPE by recursive DuckDB queries, one in-memory database for each Python worker.

A text is cut by the split pattern; each distinct piece is a word of token-position rows that join the merge table (all
pairs of tokens whose joint bytes are a token, with its rank); a recursive step contracts each word's leftmost pair of
least rank until no pair is left. Ordered aggregation over positions gives the ids and, over the tokens' bytes, the
decoded word. Results of words are kept in bounded tables of the worker, so that a common word is contracted once.

A piece of over LONG_WORD bytes (a run with no break, such as encoded data) is contracted by the same rule with a heap:
the recursion keeps a row for each position and step, which is the square of the length.

Defined cases: null and empty texts have no tokens and decode to nothing; equal rows give equal results; the texts of the
input may hold anything, special tokens' names are plain text; clashing column names are renamed (`fresh`).
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._stage import fresh

LONG_WORD = 512
WORDS_KEPT, UNITS_KEPT, WORDS_AT_ONCE = 100_000, 250_000, 20_000
_SHIFT = 1 << 40

#: t has a row for each token and its successor: their ids l and r (-1: none) and where they begin, p and q. A step takes
#: the best pair's own row out and puts the joint id into the rows beside it.
_CONTRACT = f"""
WITH RECURSIVE t(step, w, p, q, l, r) AS (
  SELECT 0, w, p, q, id, next_id FROM start
  UNION ALL
  (WITH best AS (
     SELECT w, min(m.id * {_SHIFT} + p) AS pick, arg_min(q, m.id * {_SHIFT} + p) AS second FROM t JOIN merges m USING (l, r) GROUP BY w)
   SELECT step + 1, w, CASE WHEN p = second THEN pick % {_SHIFT} ELSE p END, q,
          CASE WHEN p = second THEN (pick // {_SHIFT})::INT ELSE l END, CASE WHEN q = pick % {_SHIFT} THEN (pick // {_SHIFT})::INT ELSE r END
   FROM t JOIN best USING (w) WHERE p <> pick % {_SHIFT}))
SELECT w, list(l ORDER BY p) AS ids, string_agg(v.hex, '' ORDER BY p) AS body
FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) JOIN vocabulary v ON v.id = l GROUP BY w
"""
_DECODE = "SELECT w, string_agg(v.hex, '' ORDER BY p) AS body FROM start JOIN vocabulary v USING (id) GROUP BY w"


def _value(ids: bytes, body: bytes) -> bytes:
    """What is kept of a word: the count of its ids' bytes, the ids and what they decode to, in one object."""
    return len(ids).to_bytes(4, "little") + ids + body


def _joined(values: list[bytes]) -> bytes:
    """The value of words end to end; that of a single word is shared."""
    if len(values) == 1:
        return values[0]
    ends = [4 + int.from_bytes(v[:4], "little") for v in values]
    return _value(b"".join([v[4:e] for v, e in zip(values, ends)]), b"".join([v[e:] for v, e in zip(values, ends)]))


def give_back() -> None:
    """Returns freed memory to the system when a task ends, as the worker may wait long for its next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Kept:
    """A table of at most 2 * most entries: the entries used since the last turn, and those of the turn before."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new

    def missing(self, keys) -> list:
        """The keys that are not kept; the others count as used."""
        out, new, old = [], self.new, self.old
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


def take_ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


class Codec:
    """Encodes and decodes by the rank file's content and the split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.unsafe = regex.compile(r"\s ").search
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = [np.array(x) for x in zip(*pairs)]
        self.con = None
        self.words, self.units = Kept(WORDS_KEPT), Kept(UNITS_KEPT)
        decimals = [f"{i} ".encode() for i in range(max(self.tokens) + 1)]
        self.decimal, self.decimal_length = np.frombuffer(b"".join(decimals), np.uint8), np.array([len(d) for d in decimals])
        self.decimal_start = np.cumsum(self.decimal_length) - self.decimal_length

    def _open(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "120MB"})
        l, r, joint = self.pairs
        self._table("merges", l=pa.array(l, pa.int32()), r=pa.array(r, pa.int32()), id=pa.array(joint, pa.int64()))
        self._table("vocabulary", id=pa.array(list(self.tokens), pa.int32()), hex=pa.array([t.hex() for t in self.tokens.values()]))

    def rest(self) -> None:
        """Gives the memory of a task back: the worker may wait while other stages need it."""
        self.words, self.units = Kept(WORDS_KEPT), Kept(UNITS_KEPT)
        if self.con is not None:
            self.con.close()
        self.con = None
        give_back()

    def _table(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _rows(self, sql: str, ids: np.ndarray, lengths: np.ndarray) -> dict:
        if self.con is None:
            self._open()
        w = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        p = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        after = np.full(len(ids), -1, np.int32)
        after[:-1] = ids[1:]
        after[np.cumsum(lengths)[lengths > 0] - 1] = -1
        self.con.register("start", pa.table({"w": w, "p": p, "q": p + 1, "id": ids.astype(np.int32), "next_id": after}))
        found = self.con.sql(sql).to_arrow_table()
        self.con.unregister("start")
        return found

    def learn(self, new: list[str]) -> None:
        """Contracts words that are not kept yet."""
        bodies = [w.encode() for w in new]
        small = [k for k, b in enumerate(bodies) if len(b) <= LONG_WORD]
        size, a = 0, 0
        for e, k in enumerate(small):
            size += len(bodies[k]) ** 2
            if e + 1 == len(small) or e + 1 - a >= WORDS_AT_ONCE or size > 2_000_000:
                part = small[a : e + 1]
                ids = self.of_byte[np.frombuffer(b"".join(bodies[k] for k in part), np.uint8)]
                found = self._rows(_CONTRACT, ids, np.array([len(bodies[k]) for k in part]))
                lists = found["ids"].combine_chunks()
                flat, ends = lists.flatten().to_numpy().astype("<i4"), np.cumsum(lists.value_lengths().to_numpy())
                packed, ends = flat.tobytes(), (4 * ends).tolist()
                decoded = map(bytes.fromhex, found["body"].to_numpy().tolist())
                self.words.new.update((new[part[w]], _value(packed[a:b], body)) for w, a, b, body in zip(found["w"].to_numpy().tolist(), [0, *ends], ends, decoded))
                size, a = 0, e + 1
        for k, b in enumerate(bodies):
            if len(b) > LONG_WORD:
                ids = self._heap(b)
                self.words.new[new[k]] = _value(np.array(ids, "<i4").tobytes(), b"".join(self.tokens[i] for i in ids))

    def _heap(self, body: bytes) -> list[int]:
        n = len(body)
        part, after, before = [bytes([b]) for b in body], list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (r := self.ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, b, len(part[a]), len(part[b])))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, la, lb = heapq.heappop(heap)
            if not (live[a] and live[b]) or after[a] != b or len(part[a]) != la or len(part[b]) != lb:
                continue
            part[a] += part[b]
            live[b], after[a] = False, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [self.ranks[part[a]] for a in range(n) if live[a]]

    def _units(self, new: list[str]) -> None:
        """Encodes and decodes text between spaces."""
        parts = [self.find(u[1:]) if u[:1] == "\0" else self.find(" " + u) for u in new]
        self.learn(self.words.missing({w for p in parts for w in p}))
        words, units = self.words.new, self.units.new
        for u, p in zip(new, parts):
            units[u] = _joined([words[w] for w in p])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts and each text's offset in them; the same of the decoded bytes.

        Where no white space stands before a space, a space always begins a piece, so text is looked up from space to
        space; other texts are looked up piece by piece."""
        self.words.turn(), self.units.turn()
        odd = {k: t for k, t in enumerate(texts.to_numpy(zero_copy_only=False).tolist()) if "\0" in t or self.unsafe(t)}
        if odd:
            texts = pc.if_else(pa.array([k in odd for k in range(len(texts))]), "", texts)
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._units(self.units.missing(names))
        values = [self.units.new[u] for u in names]
        data, length = np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values])
        start = np.cumsum(length) - length
        size = take_ranges(data, start, np.full(len(start), 4)).view("<u4").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])

        def gather(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            upto = np.concatenate([[0], np.cumsum(many[codes])])
            return take_ranges(data, first[codes], many[codes]), upto[ends]

        ids, id_at = gather(start + 4, size)
        body, body_at = gather(start + 4 + size, length - 4 - size)
        ids, id_at = ids.view("<i4"), id_at // 4
        if odd:
            ids, body = np.split(ids, id_at[1:-1]), np.split(body, body_at[1:-1])
            for k, t in odd.items():
                pieces = self.find(t)
                self.learn(self.words.missing(set(pieces)))
                found = _joined([self.words.new[w] for w in pieces])
                end = 4 + int.from_bytes(found[:4], "little")
                ids[k], body[k] = np.frombuffer(found[4:end], "<i4"), np.frombuffer(found[end:], np.uint8)
            id_at, body_at = (np.cumsum([0, *map(len, x)]) for x in (ids, body))
            ids, body = np.concatenate(ids), np.concatenate(body)
        return ids, id_at, body, body_at

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by spaces."""
        many = self.decimal_length[ids]
        data = take_ranges(self.decimal, self.decimal_start[ids], many).tobytes()
        ends = np.concatenate([[0], np.cumsum(many)])[at].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids, by ordered aggregation."""
        out = [b""] * len(rows)
        lengths = np.array([len(r) for r in rows])
        if lengths.sum():
            found = self._rows(_DECODE, np.concatenate(rows), lengths)
            for w, body in zip(found["w"].to_numpy().tolist(), found["body"].to_numpy().tolist()):
                out[w] = bytes.fromhex(body)
        return out


_codecs: dict[bytes, Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _read(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:  # on the driver; its content goes with the job
        return f.read(), pattern or public_tokenizers.PATTERN


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    from ._text import slices

    return slices(batch, column, most)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns `keep` (all, if None), n_tokens, and as asked for ids, ids_sha256 and decoded_sha256."""
    keep = docs.columns if keep is None else keep
    ranks, pattern = _read(path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file
    names = [fresh(keep, c) for c in ("n_tokens", *(["ids"] * ids), *(["ids_sha256", "decoded_sha256"] * digests))]
    body = fresh(docs.columns, "body_text")
    kinds = [T.LongType(), *([T.ArrayType(T.IntegerType())] * ids), *([T.StringType()] * 2 * digests)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(c, k) for c, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for part in _parts(batch, body):
                i, i_at, b, b_at = codec.encode(part.column(body))
                columns = [pa.array(np.diff(i_at))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(i_at, pa.int32()), pa.array(i)))
                if digests:
                    columns.append(pa.array([hashlib.sha256(d).hexdigest() for d in codec.decimals(i, i_at)]))
                    columns.append(pa.array([hashlib.sha256(b[x:y]).hexdigest() for x, y in zip(b_at, b_at[1:])]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)
        codec.rest()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", result: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give nothing."""
    ranks, pattern = _read(path, pattern)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    result = fresh(encoded.columns, result)
    schema = T.StructType([*encoded.schema.fields, T.StructField(result, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [np.array(x.as_py() or [], np.int32) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(rows), pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], ids=False, digests=True)
