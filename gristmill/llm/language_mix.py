"""Language identification by inference over mixtures of languages.

Learning: letters of all training texts, lower-cased, words parted by one space; every run of `ORDER` bytes is a gram, counted
by language in `buckets` hashed cells. A cell's evidence for language l is log((1 - back) q_l / q + back), with q_l the cell's
share in l and q the mean of the shares of all languages, so that neither a frequent language nor one with little text
is favoured; a cell that no language has is neutral.

Inference: a word's likelihood in l is the product of the evidence of the grams that end in it, to the power of 1 / ORDER as
each byte is in that many grams. A document draws a language for each word; expectation-maximisation estimates the
proportions, first of all languages, then of the k strongest for k = 1, 2, ... as long as any document gains. The set with
the largest likelihood less penalty * (k - 1) * log(1 + words) is kept; the prediction is its strongest language, the score
that language's proportion.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing was learned; ties go to
the language that sorts first; repeated rows are learned from and predicted as often as they occur; a null id counts as the
empty string where ids divide the rows; texts are whole, in pieces of `PIECE` bytes, cut at a word's end, while grams are
looked up; other columns are not looked at.

The model is a table of buckets * languages numbers: `buckets` is the largest power of two up to 2**18 that keeps it within
2**24 cells (64 MB), whatever the corpus; more than 2**12 languages raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch
from ._text import flat, slices

ORDER = 4
PIECE = 4 << 20
UNDETERMINED = "und"
_SPACE = 0x20


def letters(text: Column) -> Column:
    """The letters and marks of a text in lower case, each run of anything else one space; null for none."""
    cleaned = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    return F.when(text.rlike(r"\p{L}"), F.trim(cleaned))


def grams(data: np.ndarray, bits: int) -> np.ndarray:
    """The hashed cell of the ORDER bytes that end at each byte; ORDER - 1 spaces stand before the first."""
    padded = np.concatenate([np.full(ORDER - 1, _SPACE, np.uint8), data])
    key = np.zeros(len(data), np.uint32)
    for k in range(ORDER):
        key = (key << np.uint32(8)) | padded[k : k + len(data)]
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, a space after each, and their offsets; a null is one space."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n, _SPACE, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)


def counts(texts: DataFrame, bits: int) -> DataFrame:
    """lang, cell and n of the grams of `texts` (lang, letters). Each partition adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "letters"):
                names = b.column("lang").dictionary_encode()
                data, offsets = _spaced(b.column("letters"))
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                code = names.indices.to_numpy()[row]
                cell = grams(data, bits)
                for k, lang in enumerate(names.dictionary.to_pylist()):
                    at = cell if len(names.dictionary) == 1 else cell[code == k]
                    total[lang] = total.get(lang, 0) + np.bincount(at, minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "cell", "n"])

    return texts.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order, and the evidence for each in every cell."""

    languages: list[str]
    bits: int
    evidence: np.ndarray

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word in each language, and the word's text. Words end at spaces; empty ones are left out."""
        found, rows, base = [], [], 0
        while base < len(data):
            stop = min(base + PIECE, len(data))
            if stop < len(data):
                cut = np.flatnonzero(data[base:stop] == _SPACE)
                stop = base + int(cut[-1]) + 1 if len(cut) else base + PIECE + int(np.argmax(data[stop:] == _SPACE)) + 1
            piece = data[base:stop]
            ends = np.flatnonzero(piece == _SPACE)
            starts = np.concatenate([[0], ends[:-1] + 1])
            real = ends > starts
            sums = np.add.reduceat(self.evidence[grams(piece, self.bits)], starts, axis=0) if len(piece) else np.zeros((0, len(self.languages)))
            found.append(sums[real].astype(np.float32) / ORDER)
            rows.append(np.searchsorted(offsets, base + starts[real], "right") - 1)
            base = stop
        empty = np.zeros((0, len(self.languages)), np.float32)
        return np.concatenate([empty, *found]), np.concatenate([np.zeros(0, np.int64), *rows])

    def mixtures(self, column: pa.Array, penalty: float, rounds: int) -> np.ndarray:
        """Proportions of the languages in each text; rows without words are all 0."""
        data, offsets = _spaced(column)
        log, row = self.words(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        docs, first = np.unique(row, return_index=True)
        if not len(docs) or not self.languages:
            return out
        n = np.diff(np.append(first, len(row)))
        of = np.repeat(np.arange(len(docs)), n)
        shift = log.max(1)
        p = np.exp(log - shift[:, None])
        fixed = np.add.reduceat(shift.astype(float), first)
        share, _ = _maximise(p, of, first, n, np.ones((len(docs), p.shape[1]), bool), rounds)
        strongest = np.argsort(-share, axis=1, kind="stable")
        best = np.full(len(docs), -np.inf)
        open_ = np.arange(len(docs))
        for k in range(1, p.shape[1] + 1):
            allowed = np.zeros(share.shape, bool)
            np.put_along_axis(allowed, strongest[:, :k], True, axis=1)
            pick = np.isin(of, open_) if len(open_) < len(docs) else slice(None)
            n_open = n[open_]
            begin = np.concatenate([[0], np.cumsum(n_open)[:-1]])
            got, value = _maximise(p[pick], np.repeat(np.arange(len(open_)), n_open), begin, n_open, allowed[open_], rounds)
            value = value + fixed[open_] - penalty * (k - 1) * np.log1p(n_open)
            better = value > best[open_]
            best[open_[better]] = value[better]
            out[docs[open_[better]]] = got[better]
            open_ = open_[better]
            if not len(open_):
                break
        return out


def _maximise(p: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document, by expectation-maximisation, and the log-likelihood there."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds if allowed.shape[1] > 1 and allowed.sum(1).max(initial=0) > 1 else 0):
        part = share.astype(np.float32)[of] * p
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        new = np.add.reduceat(part, first, axis=0, dtype=float) / n[:, None]
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < 1e-3:
            break
    mass = np.maximum((share[of] * p).sum(1), 1e-30)
    return share, np.add.reduceat(np.log(mass), first) if len(first) else np.zeros(0)


def learn(texts: DataFrame, lang: str = "lang", text: str = "text", back: float = 0.1) -> Model:
    """The model of all rows of `texts` that have a language; what comes to the driver is the table, at most 2**24 cells."""
    known = texts.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), letters(F.col(f"`{text}`")).alias("letters")).where("letters is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit((1 << 12) + 1).collect())
    if len(languages) > 1 << 12:
        raise ValueError("more than 4096 languages to learn")
    bits = min(18, 24 - max(0, (len(languages) - 1).bit_length()))
    table = np.zeros((1 << bits, len(languages)))
    if languages:
        place = {x: k for k, x in enumerate(languages)}
        kept = Scratch(texts.sparkSession, "language-counts").keep(counts(known, bits), "counts")
        got = kept.toArrow()
        langs = got["lang"].combine_chunks().dictionary_encode()
        code = np.array([place[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        table[got["cell"].to_numpy(), code] = got["n"].to_numpy()
    share = table / np.maximum(table.sum(0), 1)
    mean = share.mean(1, keepdims=True) if languages else np.zeros((1 << bits, 1))
    evidence = np.log(np.where(mean > 0, (1 - back) * share / np.where(mean > 0, mean, 1) + back, 1.0)).astype(np.float32)
    return Model(languages, bits, evidence)


def predict(model: Model, docs: DataFrame, keep: list[Column | str], text: str = "text", penalty: float = 2.0, rounds: int = 20) -> DataFrame:
    """The columns `keep`, lang_pred, score and mixture (language -> proportion, of the set that was chosen) of each row."""
    names = model.languages
    kept = docs.select(*keep).dtypes
    columns = [*[c for c, _ in kept], "lang_pred", "score", "mixture"]
    table = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "letters"):
                share = table.value.mixtures(b.column("letters"), penalty, rounds)
                top = share.argmax(1) if names else np.zeros(len(share), np.int64)
                score = share[np.arange(len(share)), top] if names else np.zeros(len(share))
                said = [names[k] if s > 0 else UNDETERMINED for k, s in zip(top, score)]
                row, lang = np.nonzero(share)
                sizes = np.bincount(row, minlength=len(share))
                mixture = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array([names[k] for k in lang], pa.string()), pa.array(share[row, lang]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.string()), pa.array(np.minimum(score, 1.0)), mixture], columns)

    schema = ", ".join([*[f"`{c}` {t}" for c, t in kept], "lang_pred string, score double, mixture map<string,double>"])
    return docs.select(*keep, letters(F.col(f"`{text}`")).alias("letters")).mapInArrow(run, schema)


def op11_language_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return predict(learn(docs.where(~held)), docs, ["doc_id", held.alias("held_out")])
