"""Language identification with hyperdimensional profiles (operator 8).

Every letter has a random +1/-1 vector. A three-letter window is bound into one vector: the
product of its letters' vectors, the first rotated twice and the second once. A text's profile is
the bundle (sum) of its windows' vectors; a language's prototype is the sum of the profiles of its
training texts, each divided by the norm of its window counts (the length of a bundle of
independent vectors but for a constant), so that long texts don't outweigh short ones. The language of a text is that of the prototype with the
largest cosine, ties going to the first in alphabetical order.

Bundling is linear, so a text's profile is computed from its distinct windows and their counts,
and a task's share of a prototype is one vector for each language; those shares are summed
after the task-side sum. What a prediction needs is one vector for each language, whatever the
corpus size; more than ``MOST_LANGUAGES`` labels raise an error rather than grow the broadcast.

Letters are characters of the Unicode letter categories in lower case; everything else between
them counts as one gap. Letter vectors come from a seeded hash into ``SYMBOLS`` vectors.

Defined cases: null text, or text without a letter: ``und``, score 0; no labelled training
text at all: ``und`` for all; null lang is never learned; a text whose best cosine is negative
scores 0; repeated rows each give a row; an empty table gives no rows; further columns are passed on, but
for columns named lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, columns, hidden, small_batches

DIM = 512
SYMBOLS = 1024
MOST_LANGUAGES = 2000
SEED = 7
MOST_COMMON = 0.3


class Profiles:
    """Letter vectors, and the vectors of the windows met so far."""

    def __init__(self, dim: int = DIM, limit: int = 60_000):
        self.dim, self.limit = dim, limit
        self.letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.letters[0] = 1  # the gap binds as the identity
        self.symbol, self.met = np.zeros(0x110000, np.uint16), np.zeros(0x110000 >> 8, bool)
        self.codes, self.vectors = np.empty(0, np.int64), np.empty((0, dim), np.float32)

    def _meet(self, pages: np.ndarray) -> None:
        """Fills the table code point -> symbol of its lower-case letter, 0 for other characters, for pages of 256."""
        for page in pages:
            for cp in range(page << 8, (page + 1) << 8):
                if (c := chr(cp)).isalpha():
                    low = ord(c.lower()[0])
                    self.symbol[cp] = low if low < 512 else 512 + (low * 2654435761 >> 7) % (SYMBOLS - 512)
            self.met[page] = True

    def windows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window codes of a text and their counts."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        pages = cps >> 8
        if not self.met[pages].all():
            self._meet(np.unique(pages[~self.met[pages]]))
        s = self.symbol[cps].astype(np.int64)
        if not s.any():
            return np.empty(0, np.int64), np.empty(0)
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        code = (s[:-2] << 20) | (s[1:-1] << 10) | s[2:]
        return np.unique(code, return_counts=True)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Indexes of the codes' vectors; new vectors are bound on the way."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(new):
            if len(self.codes) + len(new) > self.limit:
                self.codes, self.vectors, new = self.codes[:0], self.vectors[:0], codes
            order = np.argsort(all_codes := np.concatenate((self.codes, new)), kind="stable")
            self.codes, self.vectors = all_codes[order], np.concatenate((self.vectors, self.bind(new)))[order]
            at = np.searchsorted(self.codes, codes)
        return at

    def bind(self, codes: np.ndarray) -> np.ndarray:
        v = np.roll(self.letters[codes >> 20], 2, axis=1) * np.roll(self.letters[(codes >> 10) & 1023], 1, axis=1) * self.letters[codes & 1023]
        return v.astype(np.float32)

    def of(self, text: str | None) -> np.ndarray | None:
        """Unit-length profile; None without a letter."""
        codes, counts = self.windows(text) if text else (np.empty(0, np.int64), None)
        if not len(codes):
            return None
        rows = self.rows(codes)
        v = np.zeros(self.dim, np.float32)
        for at in range(0, len(rows), 4096):
            v += counts[at : at + 4096].astype(np.float32) @ self.vectors[rows[at : at + 4096]]
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit-length prototype of every label in ``docs`` (rows with a null label or text are passed over)."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, held, size, out = None, {}, 0, {}

        def fold() -> None:
            for k, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                weight = np.bincount(at, np.concatenate([p[1] for p in parts]))
                for i in range(0, len(codes), 4096):
                    out[k] = out.get(k, 0) + weight[i : i + 4096] @ profiles.bind(codes[i : i + 4096]).astype(np.float64)
            held.clear()

        for b in small_batches(batches, 256):
            profiles = profiles or Profiles(dim)
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, counts = profiles.windows(t)
                if len(codes):
                    held.setdefault(k, []).append((codes, counts / np.sqrt((counts.astype(float) ** 2).sum())))
                    size += len(codes)
            if size > 2_000_000:
                fold()
                size = 0
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([x.tolist() for x in out.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    got = summed.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for r in sorted(got, key=lambda r: r["lang"]):
        v = np.array([x["x"] for x in r["v"]])
        out[r["lang"]] = (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """Adds lang_pred and score to ``docs``, which needs a column text; columns of those names are replaced."""
    batch_rows(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    own = docs.columns
    docs = docs.toDF(*[f"_{i}" for i in range(len(own))])
    at = own.index("text")
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.empty((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = None
        for b in small_batches(batches, 256):
            profiles = profiles or Profiles(dim)
            langs, scores = [], []
            for t in b.column(at).to_pylist():
                v = profiles.of(t)
                if v is None or not names:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cos = matrix @ v
                    i = int(np.argmax(cos))
                    langs.append(names[i])
                    scores.append(float(min(1.0, max(0.0, cos[i]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double"
    return docs.mapInArrow(run, ddl).toDF(*own, "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in one of the languages of their labels, with their columns."""
    plain, back = hidden(docs, "text")
    prototypes = learn(docs)
    return back(predict(plain, prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(prototypes))))


def least_score(prototypes: dict[str, np.ndarray], dim: int = DIM) -> float:
    """The cosine that a text in one of the languages reaches: what texts in different languages have in common, as the
    most alike prototypes have, and four standard deviations of the cosine of independent vectors, 1 / sqrt(dim).
    The common part counts as MOST_COMMON at most, so that one language under two labels doesn't raise the bar."""
    m = np.stack(list(prototypes.values())) if prototypes else np.empty((0, dim))
    common = (m @ m.T)[np.triu_indices(len(m), 1)].max(initial=0.0)
    return float(min(common, MOST_COMMON) + 4 / np.sqrt(dim))


def in_fold(k: int, r: int, name: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod k is r; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % k == r


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    prototypes = learn(docs.where(~in_fold(3, 1)))
    rows = docs.select("doc_id", in_fold(3, 1).alias("held_out"), "text")
    return predict(rows, prototypes).drop("text")
