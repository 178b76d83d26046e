"""Benchmark decontamination by SimHash windows (operator 7).

Every window of a document that is as long as some benchmark item gets a 256-bit SimHash of its
weighted 5-word shingles: of the pairs of a shingle and how many equal ones come before it, so that
the weighted similarity is that of two sets. Items are indexed by ``BLOCKS`` blocks of their
own SimHash: two fingerprints within ``RADIUS`` bits differ in at most RADIUS // BLOCKS bits in
some block, so looking up each block with all such changes finds every item within the radius.
Candidates are confirmed by the exact weighted Jaccard similarity of the shingles, 0.75 or more.

At that similarity a SimHash bit differs with a probability of 0.172 in long texts and 0.1875 at most (3 of 4
shingles shared), so a radius of 79 leaves out 1.2 pairs in a million at most. A fingerprint of other text is
within the radius with a probability of 5e-10; 64 bits and their radius of 27 let 13 % of them through.

Windows that cannot reach the similarity get no fingerprint: the shared weight of a window with
an item of L shingles must be at least 0.75 L, so fewer positions than that holding shingles of
items of that length rule it out. That bound is exact.

The items (stated queries) are sent to all tasks in blocks of about ``BLOCK_BYTES`` of text, one at a time: a larger
benchmark makes more passes over the documents, with a checkpoint after each, so that a task and the driver hold
one block only. Documents are never shuffled.

Defined cases: an item without an item_id matches as any other, all such items counting as one with a null
item_id, as items that share an item_id count as one; null or empty text: kept, no items; an item without words matches nothing; items or
documents of fewer than five words: the whole sequence is one shingle; a document shorter than
an item is one window; repeated rows each give a row; an empty benchmark keeps all; further
columns are passed on, but for one named _items, which is replaced.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch_rows, columns, cut, encoded_words, hidden, ragged, shingles, small_batches, words

WIDTH = 5
BITS, RADIUS, BLOCKS = 256, 79, 16
PERCENT = 75
#: Windows whose sums are held at once.
RUN = 4096
BLOCK_BYTES = 16 << 20
#: All changes of up to RADIUS // BLOCKS bits in a block.
_CHANGES = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(BITS // BLOCKS), r)], np.uint16)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(h: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1/-1 from hashes, by a generator that each hash seeds."""
    wide = _mixed(h[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _STEP)
    return (np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int32) << 1) - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) uint16 fingerprints of rows of BITS sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def ranked(s: np.ndarray) -> np.ndarray:
    """Hashes of each shingle with the number of equal ones before it."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    before = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = s.copy()
    out[order] = np.where(before > 0, _mixed(t + before.astype(np.uint64) * _STEP), t)
    return out


class Prints:
    """Fingerprints of items, to be looked up by block."""

    def __init__(self, items: list[int], prints: np.ndarray):
        self.items, self.wide, self.blocks = np.array(items), np.ascontiguousarray(prints).view(np.uint64), []
        for b in range(BLOCKS):
            order = np.argsort(prints[:, b], kind="stable")
            values, first = np.unique(prints[order, b], return_index=True)
            self.blocks.append((values, np.append(first, len(order)), order))

    def candidates(self, f: np.ndarray) -> np.ndarray:
        """Rows that a block of f, with any of the changes, finds: by the changes, or by the values where these are fewer."""
        found = np.zeros(len(self.items), bool)
        for v, (values, first, order) in zip(f, self.blocks, strict=True):
            if len(values) <= len(_CHANGES):
                at = np.flatnonzero(np.bitwise_count(values ^ v) <= RADIUS // BLOCKS)
            else:
                changed = _CHANGES ^ v
                at = np.searchsorted(values, changed)
                at[at == len(values)] = 0
                at = at[values[at] == changed]
            found[order[ragged(first[at], first[at + 1] - first[at])]] = True
        return np.flatnonzero(found)

    def near(self, f: np.ndarray) -> list[int]:
        """Items within the radius of f."""
        rows = self.candidates(f)
        return self.items[rows[np.bitwise_count(self.wide[rows] ^ f.view(np.uint64)).sum(axis=1) <= RADIUS]].tolist()


class Index:
    """Benchmark items: shingles for the exact bound, and blocks of fingerprints by window length."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        hashes = WordHashes()
        self.items, by_length = [], defaultdict(list)
        seen, lengths = [], []
        for item, text in items:
            h = hashes.of(words(text))
            if not len(h):
                continue
            s = shingles(h, WIDTH)
            by_length[len(h)].append((len(self.items), fingerprint(signs(ranked(s)).sum(axis=0)[None, :])))
            self.items.append((item, Counter(s.tolist()), len(s)))
            seen.append(s)
            lengths.append(len(h))
        self.by_length = {n: Prints([k for k, _ in own], np.concatenate([f for _, f in own])) for n, own in by_length.items()}
        self.lengths = sorted(self.by_length)
        self.shingles = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint64)
        #: Which window lengths have an item with the shingle.
        self.of_length = np.zeros((len(self.shingles), len(self.lengths)), bool)
        for length, s in zip(lengths, seen, strict=True):
            self.of_length[np.searchsorted(self.shingles, s), self.lengths.index(length)] = True
        self.found: dict[tuple[int, bytes], list[int]] = {}

    def near(self, length: int, f: np.ndarray) -> list[int]:
        """Items of that length within the radius of a fingerprint."""
        if (got := self.found.get((length, f.tobytes()))) is not None:
            return got
        if len(self.found) > 100_000:
            self.found.clear()
        out = self.found[length, f.tobytes()] = self.by_length[length].near(f)
        return out

    def ids(self, s: np.ndarray) -> np.ndarray:
        """Index of each shingle among the benchmark's, -1 where it isn't there."""
        if not len(self.shingles):
            return np.full(len(s), -1)
        i = np.searchsorted(self.shingles, s)
        i[i == len(self.shingles)] = 0
        return np.where(self.shingles[i] == s, i, -1)

    def find(self, h: np.ndarray) -> dict[int, float]:
        """item -> best similarity over all windows of a document's word hashes."""
        best: dict[int | None, float] = {}
        n = len(h)
        if not n:
            return best
        if n >= WIDTH:
            s = shingles(h, WIDTH)
            ids = self.ids(s)
            at = np.flatnonzero(ids >= 0)
            if len(at):
                use = self.of_length[ids[at]]
                for k in np.flatnonzero(use.sum(axis=0)):
                    if (length := self.lengths[k]) >= WIDTH:
                        self.windows(length, s, at[use[:, k]], max(1, min(length, n) - WIDTH + 1), best)
        for length in self.lengths:
            if length >= WIDTH:
                break
            if n >= length:
                s = shingles_of(h, length)
                self.windows(length, s, np.flatnonzero(self.ids(s) >= 0), 1, best)
        return best

    def windows(self, length: int, s: np.ndarray, hits: np.ndarray, size: int, best: dict[int, float]) -> None:
        """Confirms items of one length in all windows of ``size`` shingles; hits: positions of their shingles."""
        need = -(-PERCENT * max(1, length - WIDTH + 1) // 100)
        if len(hits) < need:
            return
        hit = np.zeros(len(s) + 1, np.int64)
        hit[hits + 1] = 1
        total = np.cumsum(hit)
        starts = np.flatnonzero(total[size:] - total[:-size] >= need)
        if not len(starts):
            return
        far = np.diff(starts) > size
        for run in (part[k : k + RUN] for part in np.split(starts, np.flatnonzero(far) + 1) for k in range(0, len(part), RUN)):
            for at, f in zip(run.tolist(), self.prints(s[run[0] : run[-1] + size], run - run[0], size), strict=True):
                if near := self.near(length, f):
                    mine = Counter(s[at : at + size].tolist())
                    for k in near:
                        item, theirs, weight = self.items[k]
                        both = sum(min(c, theirs[x]) for x, c in mine.items() if x in theirs)
                        if 100 * both >= PERCENT * (size + weight - both):
                            best[item] = max(best.get(item, 0.0), both / (size + weight - both))


    @staticmethod
    def prints(s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of ``size`` shingles at ``starts``: differences of running sums where no
        shingle repeats, each on its own elsewhere."""
        total = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(s), axis=0, dtype=np.int32)))
        out = fingerprint(total[starts + size] - total[starts])
        order = np.argsort(s, kind="stable")
        again = np.flatnonzero(s[order][1:] == s[order][:-1])
        if len(again):
            after = np.full(len(s), len(s) + size)
            after[order[again]] = order[again + 1]
            soonest = np.minimum.accumulate(after[::-1])[::-1]  # where a shingle that begins the window or follows comes again
            for k in np.flatnonzero(soonest[starts] < starts + size):
                out[k] = fingerprint(signs(ranked(s[starts[k] : starts[k] + size])).sum(axis=0)[None, :])[0]
        return out


def shingles_of(h: np.ndarray, length: int) -> np.ndarray:
    """Whole-sequence hashes of every window of fewer than five words."""
    return np.concatenate([shingles(h[i : i + length], WIDTH) for i in range(len(h) - length + 1)])


def match_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds _items (array<struct<item_id, similarity>>) to ``docs``, which needs a column text; a column of that name is replaced."""
    spark = docs.sparkSession
    batch_rows(spark)
    docs = docs.drop("_items")
    own = docs.columns
    docs = docs.toDF(*[f"_{i}" for i in range(len(own))])
    at = own.index("text")
    items = columns(benchmark, "item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    kind = "array<struct<item_id:bigint,similarity:double>>"
    out = docs.withColumn("_items", F.array().cast(kind))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", _items {kind}"
    for k in range(blocks):
        block = [(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.col("text"))), F.lit(blocks)) == k).select("item_id", F.col("text").cast("binary")).collect()]
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
            for b in small_batches(batches, 128):
                found = []
                ws, number, off = encoded_words(b.column(at), lower=True)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))[number]
                for first, last, old in zip(off[:-1], off[1:], b.column(b.num_columns - 1).to_pylist(), strict=True):
                    best = index.find(h[first:last])
                    if old and (null := [x["similarity"] for x in old if x["item_id"] is None]) and None in best:
                        best[None] = max(best[None], *null)
                        old = [x for x in old if x["item_id"] is not None]
                    ordered = sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))
                    found.append([*(old or []), *({"item_id": i, "similarity": s} for i, s in ordered)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, arrow)], names=b.schema.names)

        out = out.mapInArrow(run, ddl)
        if k < blocks - 1:
            out = cut(out)
            shared.destroy()
    return out.toDF(*own, "_items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, with their columns."""
    plain, back = hidden(docs, "text")
    return back(match_items(plain, benchmark).where(F.size("_items") == 0))


def op7_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = match_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.coalesce(F.array_max(F.transform("_items", lambda x: x["similarity"])), F.lit(0.0))
    return out.select("doc_id", (F.size("_items") == 0).alias("kept"), F.size("_items").alias("n_items"), F.array_sort(F.transform("_items", lambda x: x["item_id"])).alias("item_ids"), F.round(best, 6).alias("similarity"))
