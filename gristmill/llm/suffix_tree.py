"""Scoring by a probabilistic suffix tree over words.

The root is the smoothed word distribution of the training documents. A context of one or more preceding words that
occurred twice is a candidate; it is retained if its followers diverge from what its suffix predicts: if the leave-one-out
log-likelihood gain over the suffix, summed over its occurrences, reaches `divergence` nats. A retained state's next-word
distribution is smoothed with its suffix's by as many pseudo-counts as it has followers (Witten and Bell). A word is
scored by the longest suffix of its history that is a retained state; a document's start and end are symbols too.

Nothing is held whole anywhere. Documents lie in slices of about `slice_bytes`; for each depth, a slice asks for its
distinct contexts and followers, with its own training counts, packed by hash part; each part adds all slices' counts,
tests its contexts and answers each slice. Words are 64-bit hashes, contexts 48-bit ones, followers of one context 24 or 32 bits
(32 from 256 occurrences on). So of n distinct contexts a share of about n / 2**48 is counted with another one (4e-6 at 10**9,
4 % at 10**13), and of the followers of a context of f followers a share of at most f / 2**24.

Defined cases: null and empty texts are the end symbol alone; a null id counts as the empty text in the split; equal rows
are counted and scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch
from ._text import flat, mix, slices, word_hashes
from .byte_bpe import give_back

_END, _START = np.uint64(0xA5A5_1234_5678_9ABC), np.uint64(0x5A5A_8765_4321_CBA9)
_LOW48 = np.uint64(2**48 - 1)
_ANSWER = "slice long, depth int, part int, data binary, n long, v long"


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _low(f: np.ndarray) -> bytes:
    return f.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _high(f: np.ndarray, often: np.ndarray) -> bytes:
    """The highest byte of the followers of frequent contexts."""
    return f.view(np.uint8).reshape(-1, 4)[often > 0, 3].tobytes()


def _from_six(data: bytes, n: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.reshape(-1).view("<u8")


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, by pieces of about a megabyte, so that what is in hand stays small."""
    words, rows, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for batch in table.to_batches():
        for piece in slices(batch, "text"):
            h, r = word_hashes(*flat(piece.column("text")))
            words.append(h)
            rows.append(r + n)
            n += piece.num_rows
    return np.concatenate(words), np.concatenate(rows)


class _Slice:
    """The words of a slice in order, each document closed by its end."""

    def __init__(self, row: pa.Table):
        table = pa.ipc.open_stream(_whole(row["docs"][0].as_py())).read_all()
        self.column = table["id"]
        self.ids = self.column.to_pylist()
        words, rows = _words(table)
        self.docs = table.num_rows
        n = len(words) + self.docs
        self.row = np.zeros(n, np.int64)
        at = np.arange(len(words)) + rows
        h = np.full(n, _END)
        h[at] = words
        ends = np.cumsum(np.bincount(rows, minlength=self.docs)) + np.arange(self.docs) if len(rows) else np.arange(self.docs)
        self.row[at], self.row[ends] = rows, np.arange(self.docs)
        self.start = np.ones(n, bool)
        self.start[1:] = self.row[1:] != self.row[:-1]
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = ~self.held[self.row]
        self.h = h
        self.unique, self.word = np.unique(h, return_inverse=True)

    def before(self, x: np.ndarray, first) -> np.ndarray:
        """x of the position before; `first` at a document's start."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.start] = first
        return out


def _ask_words(s: _Slice, parts: int) -> Iterator[tuple[int, bytes]]:
    count = np.bincount(s.word, weights=s.train, minlength=len(s.unique)).astype("<u4")
    part = _part(s.unique, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        k = order[cuts[p] : cuts[p + 1]]
        if len(k):
            yield p, _small(s.unique[k].astype("<u8").tobytes() + count[k].tobytes())


def _answer_words(rows: list[bytes]) -> tuple[list[bytes], int, int]:
    rows = [_whole(r) for r in rows]
    many = np.array([len(r) // 12 for r in rows])
    h = np.concatenate([np.frombuffer(r, "<u8", m) for r, m in zip(rows, many)])
    c = np.concatenate([np.frombuffer(r, "<u4", m, 8 * m) for r, m in zip(rows, many)])
    unique, at = np.unique(h, return_inverse=True)
    total = np.bincount(at, weights=c, minlength=len(unique)).astype(np.int64)
    out = total[at].astype("<u4")
    cuts = np.cumsum(many)[:-1]
    return [_small(x.tobytes()) for x in np.split(out, cuts)], int(total.sum()), int((total > 0).sum())


class _Pairs:
    """The distinct (context, follower) pairs of a slice at one depth, by part."""

    def __init__(self, s: _Slice, context: np.ndarray, open_: np.ndarray, total: np.ndarray, parts: int):
        """total: how often training holds the context. Followers of one met up to 255 times are 24-bit hashes."""
        self.at = np.flatnonzero(open_)
        self.contexts, c = np.unique(context[self.at] & _LOW48, return_inverse=True)
        part = _part(self.contexts, parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.contexts, self.part = self.contexts[order], part[order]
        often = total[self.at] > 255
        self.often = np.zeros(len(self.contexts), np.uint8)
        self.often[rank[c]] = often
        key = (rank[c].astype(np.uint64) << np.uint64(32)) | (mix(s.h[self.at]) & np.where(often, np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFF)))
        keys, self.first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.of = (keys >> np.uint64(32)).astype(np.int64)
        self.follower = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))
        self.pair_cuts = np.searchsorted(self.of, self.cuts)

    def ask(self, s: _Slice, p: np.ndarray) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(self.pair, weights=s.train[self.at], minlength=len(self.of)).astype("<u4")
        bits = np.minimum(255, np.round(-8 * np.log2(p[self.at[self.first]]))).astype(np.uint8)
        bits[count == 0] = 0  # only followers that training has are tested
        each = np.bincount(self.of, minlength=len(self.contexts)).astype("<u4")
        for k, (a, b, x, y) in enumerate(zip(self.cuts, self.cuts[1:], self.pair_cuts, self.pair_cuts[1:])):
            if b > a:
                yield k, _small(np.array([b - a], "<u4").tobytes() + _six(self.contexts[a:b]) + each[a:b].tobytes() + self.often[a:b].tobytes() + _low(self.follower[x:y]) + _high(self.follower[x:y], self.often[self.of[x:y]]) + count[x:y].tobytes() + bits[x:y].tobytes())

    def take(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each position's context (0: not retained) and count of its follower there."""
        n, m = len(self.contexts), len(self.of)
        weight, count = np.zeros(n, np.int64), np.zeros(m, np.int64)
        for k, data in answers.items():
            a, b, x, y = self.cuts[k], self.cuts[k + 1], self.pair_cuts[k], self.pair_cuts[k + 1]
            v = np.frombuffer(_whole(data), "<u4")
            weight[a:b], count[x:y] = v[: b - a], v[b - a :]
        return weight[self.of[self.pair]], count[self.pair]


def _answer_pairs(rows: list[bytes], divergence: float) -> list[bytes]:
    contexts, eachs, followers, counts, bits, sizes = [], [], [], [], [], []
    for r in map(_whole, rows):
        n = int(np.frombuffer(r, "<u4", 1)[0])
        contexts.append(_from_six(r, n, 4))
        eachs.append(np.frombuffer(r, "<u4", n, 4 + 6 * n))
        often = np.repeat(np.frombuffer(r, np.uint8, n, 4 + 10 * n), eachs[-1]) > 0
        m, high, at = len(often), int(often.sum()), 4 + 11 * n
        f = np.zeros((m, 4), np.uint8)
        f[:, :3] = np.frombuffer(r, np.uint8, 3 * m, at).reshape(m, 3)
        f[often, 3] = np.frombuffer(r, np.uint8, high, at + 3 * m)
        followers.append(f.reshape(-1).view("<u4"))
        counts.append(np.frombuffer(r, "<u4", m, at + 3 * m + high))
        bits.append(np.frombuffer(r, np.uint8, m, at + 7 * m + high))
        sizes.append((n, m))
    unique, c = np.unique(np.concatenate(contexts), return_inverse=True)
    key = (np.repeat(c, np.concatenate(eachs)).astype(np.uint64) << np.uint64(32)) | np.concatenate(followers).astype(np.uint64)
    keys, pair = np.unique(key, return_inverse=True)
    total = np.bincount(pair, weights=np.concatenate(counts), minlength=len(keys))
    of = (keys >> np.uint64(32)).astype(np.int64)
    most = np.zeros(len(keys), np.uint8)
    np.maximum.at(most, pair, np.concatenate(bits))
    p = np.exp2(most / -8.0)
    n = np.bincount(of, weights=total, minlength=len(unique))
    kinds = np.bincount(of, weights=total > 0, minlength=len(unique))
    rest = kinds[of] - (total == 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        loo = (total - 1 + rest * p) / (n[of] - 1 + rest)
        gain = np.where((total > 0) & (n[of] >= 2), total * np.log(np.maximum(loo, 1e-300) / p), 0.0)
    kept = (n >= 2) & (np.bincount(of, weights=gain, minlength=len(unique)) >= divergence)
    weight = np.where(kept, kinds, 0).astype("<u4")
    out, a, b = [], 0, 0
    total = total.astype("<u4")
    for x, y in sizes:
        out.append(_small(weight[c[a : a + x]].tobytes() + total[pair[b : b + y]].tobytes()))
        a, b = a + x, b + y
    return out


def _walk(s: _Slice, answers: dict[tuple[int, int], bytes], depth: int, n: int, v: int, parts: int, only_ask: bool):
    """Probabilities of all positions by the states of up to `depth` words; if only_ask, of fewer, and the pairs there."""
    part = _part(s.unique, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    count = np.zeros(len(s.unique), np.int64)
    for p in range(parts):
        if (0, p) in answers:
            count[order[cuts[p] : cuts[p + 1]]] = np.frombuffer(_whole(answers[0, p]), "<u4")
    known = count[s.word]
    base = (known + 0.5) / (n + 0.5 * (v + 1))
    p, context = base, np.zeros(len(s.h), np.uint64)
    starts = count[np.searchsorted(s.unique, _END)]  # as many documents start as end
    seen = known  # how often training holds the word after its context of the depth before, so: the next context
    open_, word = np.ones(len(s.h), bool), s.h
    for d in range(1, depth + 1):
        # The context of d words: that of d - 1 words of the position before, and the word before.
        longer = context * np.uint64(0x9E3779B97F4A7C15) + (word if d == 1 else mix(word))
        context = mix(s.before(longer, _START if d == 1 else np.uint64(0)) + np.uint64(d))
        open_ = s.before(open_ & (seen >= 2), d == 1)
        total = s.before(seen, starts if d == 1 else 0)
        pairs = _Pairs(s, context, open_, total, parts)
        if d == depth and only_ask:
            return base, p, known, pairs
        weight, follow = pairs.take({k: x for (level, k), x in answers.items() if level == d})
        p = p.copy()
        use = weight > 0
        i = pairs.at[use]
        p[i] = (follow[use] + weight[use] * p[i]) / (total[i] + weight[use])
        seen = np.zeros(len(s.h), np.int64)
        seen[pairs.at] = follow
    return base, p, known, None


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = 2, divergence: float = 2.0, slice_bytes: int = 9 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    source = docs.select(F.spark_partition_id().alias("p"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = size = k = 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for h in held:
                    out.write_batch(h)
            row = [pa.array([part * (1 << 24) + k], pa.int64()), pa.array([size], pa.int64()), pa.array([_small(sink.getvalue().to_pybytes())], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["slice", "size", "docs"])

        for batch in batches:
            for piece in slices(batch, "text", slice_bytes // 8):
                part = piece.column("p")[0].as_py()
                held.append(piece.select(["id", "text"]))
                size += pc.sum(pc.binary_length(piece.column("text"))).as_py()
                if size >= slice_bytes * 3 // 4:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    # One compressed row a slice: texts move once for each depth.
    sliced = scratch.keep(source.mapInArrow(cut, "slice long, size long, docs binary"), "slices")
    size = sliced.agg(F.sum("size")).first()[0] or 0
    parts = max(12, math.ceil(size / part_bytes))
    schema = "slice long, part int, data binary"

    def rows(key: int, asked: Iterator[tuple[int, bytes]]) -> pa.Table:
        found = list(asked)
        return pa.table({"slice": pa.array([key] * len(found), pa.int64()), "part": pa.array([p for p, _ in found], pa.int32()), "data": pa.array([d for _, d in found], pa.binary())})

    def ask_words(key, table):
        return rows(key[0].as_py(), _ask_words(_Slice(table), parts))

    def answering(level: int):
        def answer(key, table):
            data = table["data"].to_pylist()
            n = v = 0
            if level:
                out = _answer_pairs(data, divergence)
            else:
                out, n, v = _answer_words(data)
            k = len(out)
            return pa.table({"slice": table["slice"], "depth": pa.array([level] * k, pa.int32()), "part": table["part"], "data": pa.array(out, pa.binary()), "n": pa.array([n, *[0] * (k - 1)], pa.int64()), "v": pa.array([v, *[0] * (k - 1)], pa.int64())})

        return answer

    answers = scratch.keep(sliced.groupBy("slice").applyInArrow(ask_words, schema).groupBy("part").applyInArrow(answering(0), _ANSWER), "words")
    n, v = answers.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0

    def given(table: pa.Table) -> dict[tuple[int, int], bytes]:
        return {(d, p): x for d, p, x in zip(table["depth"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist())}

    for level in range(1, depth + 1):

        def ask(key, left: pa.Table, right: pa.Table, level=level) -> pa.Table:
            if not left.num_rows:
                return rows(0, iter(()))
            s = _Slice(left)
            _, p, _, pairs = _walk(s, given(right), level, n, v, parts, True)
            return rows(key[0].as_py(), pairs.ask(s, p))

        asked = sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_three(ask), schema)
        answers = answers.union(scratch.keep(asked.groupBy("part").applyInArrow(answering(level), _ANSWER), f"depth-{level}"))

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        s = _Slice(left)
        base, p, known, _ = _walk(s, given(right), depth, n, v, parts, False)
        per = lambda x: np.bincount(s.row, weights=x, minlength=s.docs)
        return pa.table({"doc_id": s.column, "held_out": pa.array(s.held), "n_tokens": pa.array(np.bincount(s.row, minlength=s.docs)), "n_known": pa.array(per(known > 0).astype(np.int64)), "train_tokens": pa.array(np.full(s.docs, n, np.int64)), "base_score": pa.array(per(np.log10(base))), "score": pa.array(per(np.log10(p)))})

    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_three(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _three(f):
    """f with exactly the three parameters that cogrouped functions are told apart by; its memory is given back."""

    def run(key, left, right):
        out = f(key, left, right)
        give_back()
        return out

    return run


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
