"""Near-duplicate documents by SuperMinHash (operator 5).

A document is the set of its distinct 5-word shingles (64-bit hashes). Its SuperMinHash
signature has ``ROWS * BANDS`` places: every element visits the places in its own random order,
the t-th with the value t + r, 0 <= r < 1, and a place keeps the least value. The places of an
element are a permutation, so signatures vary less than with independent hashes, and a document
is done as soon as every place holds a value below the next t (early stopping).

Candidates are documents that share a band, links are confirmed on the full sets, and groups are
the connected components of the links. With 40 bands of 4 a pair at similarity 0.75 shares no band
with probability (1 - 0.75**4)**40 = 2.6e-7, less above it.

Nothing is quadratic in a group of copies, and no link between different texts is dropped:

1. Documents with equal sets collapse to the one with the smallest doc_id.
2. In each band bucket every member is paired with one centre only. Each document first
   confirms the pair that most buckets propose; confirmed links give components.
3. Buckets whose members are all in one component are settled. In the others, members are
   compared across components only, in blocks of ``BLOCK`` members: sketches rule out pairs
   estimated below ``LEAST_ESTIMATE``. A sketch keeps one byte of the least element in each of
   ``BINS`` ranges of the hash, so it is nearly exact for sets up to that size, and for large sets
   the bound is about five standard deviations under 0.75. In a small set one collision of two elements
   may take 3/4 below the bound, so a set of fewer than ``SKETCHED`` elements is never ruled out by it.
   Of any two components the best pairs are confirmed first and join them, so few are left
   for the last round, which takes every pair that remains.

Components come from rounds of large-star and small-star edges, so a hub with very many links is
aggregated before the shuffle. Candidates, links and labels stay distributed.

Defined cases: null, empty or blank text: no shingles, linked with nothing; fewer than five
words: the word sequence is the one shingle; a null doc_id: linked with nothing, component_id
null, kept; rows that share a doc_id are one vertex; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, columns, cut, encoded_words, forget, mix64, shingles, small_batches

ROWS, BANDS = 4, 40
PLACES = ROWS * BANDS
BLOCK = 512
BINS = 1024
LEAST_ESTIMATE = 0.68
SKETCHED = 64
#: Pairs that a block proposes for any two components, round by round; 0: all that are left.
ROUNDS = (1, 0)
PERCENT = 75
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def superminhash(values: np.ndarray, doc: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n_docs, places) of uint32: rank in the upper 8 bits, 24 random bits below.

    values: the elements of all documents; doc: the document (0..n_docs-1) of each, ascending."""
    sig = np.full((n_docs, places), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    order: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for t in range(places):
            rnd = mix64(values + _GOLD * np.uint64(t + 1))
            k = t + (((rnd & np.uint64(0xFFFFFFFF)) * np.uint64(places - t)) >> np.uint64(32)).astype(np.int64)
            if order is None:
                at = k
            else:
                rows = np.arange(len(values))
                at = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, t]
                order[:, t] = at
            np.minimum.at(flat, doc * places + at, (np.uint32(t) << np.uint32(24)) | (rnd >> np.uint64(40)).astype(np.uint32))
            if t + 1 == places:
                break
            open_docs = sig.max(axis=1) >= np.uint32(t + 1) << np.uint32(24)
            going = open_docs[doc]
            if not going.any():
                break
            if order is None:
                values, doc, k = values[going], doc[going], k[going]
                order = np.tile(np.arange(places, dtype=np.uint8), (len(values), 1))
                rows = np.arange(len(values))
                order[rows, k] = 0
                order[:, 0] = k
            elif not going.all():
                values, doc, order = values[going], doc[going], order[going]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) of int64: hash of each band's rows and its number."""
    s = sig.reshape(len(sig), -1, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix64(np.arange(1, s.shape[1] + 1, dtype=np.uint64) * _GOLD), s.shape[:2]).copy()
        for r in range(ROWS):
            acc = mix64(acc * _GOLD + s[:, :, r])
    return acc.view(np.int64)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    ws, number, off = encoded_words(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))[number]
    return [np.unique(shingles(h[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 64):
        sets = _sets(b.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets))
        keys = band_keys(sig)
        full = [x > 0 for x in n]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array(n),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                b.column("tkey"),
                pa.array([k.astype(np.int32).tobytes() if f else None for k, f in zip(keys, full, strict=True)], pa.binary()),
                pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n", "digest", "tkey", "short", "bands"],
        )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 64):
        sets = _sets(b.column("text"))
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(sets)), np.diff(off))
        drawn = sketches(flat.view(np.uint64), doc, len(sets))
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array([zlib.compress(x.tobytes(), 1) for x in drawn], pa.binary()), b.column("short")], names=["rep", "set", "sketch", "short"])


def sketches(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, BINS) of uint8: 0 for an empty bin, else 1 to 255 from the least element in it."""
    with np.errstate(over="ignore"):
        h = mix64(values + _GOLD)
    least = np.full(n_docs * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, doc * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), h)
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(empty, 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(n_docs, BINS)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of edges (a, b): the smallest vertex it can reach."""
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        least2 = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(least2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        # at the fixed point every vertex has one edge, to the least vertex of its component
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(F.col("i") * 100 >= PERCENT * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _compare(most: int):
    """Pairs across components within each (key, li, ri) group, by set size and sketch estimate: of any two
    components the ``most`` pairs with the highest estimates, or all where it is 0. A pair that shares several
    bands is left to the first of them, whose bucket holds the same two components."""

    def pairs(rows: list[tuple], key: int) -> np.ndarray:
        left = [r for r in rows if r[4]]
        right = [r for r in rows if r[5]]
        if not left or not right:
            return np.empty((0, 2), np.int64)
        sl, sr = (np.frombuffer(b"".join(zlib.decompress(r[3]) for r in x), np.uint8).reshape(len(x), BINS) for x in (left, right))
        bl, br = (np.frombuffer(b"".join(r[6] for r in x), np.int32).reshape(len(x), BANDS) for x in (left, right))
        own = np.int32((key & 0xFFFFFFFF) - ((key & 0x80000000) << 1))
        il, cl, nl = (np.array([r[k] for r in left], np.int64) for k in (0, 1, 2))
        ir, cr, nr = (np.array([r[k] for r in right], np.int64) for k in (0, 1, 2))
        out = []
        for k in range(len(left)):
            j = np.flatnonzero((cr != cl[k]) & (100 * np.minimum(nr, nl[k]) >= PERCENT * np.maximum(nr, nl[k])))
            if len(j):
                j = j[bl[k][(br[j] == bl[k]).argmax(axis=1)] == own]
            if len(j):
                held = (sr[j] | sl[k]) != 0
                same = ((sr[j] == sl[k]) & held).sum(axis=1) / held.sum(axis=1)
                same = np.round((same - 1 / 255) / (1 - 1 / 255) * 1e6).astype(np.int64)
                stay = (same >= LEAST_ESTIMATE * 1e6) | (np.minimum(nr[j], nl[k]) < SKETCHED)
                j, same = j[stay], same[stay]
                a, b, ca, cb = il[k], ir[j], cl[k], cr[j]
                out.append(np.stack((np.minimum(a, b), np.maximum(a, b), np.minimum(ca, cb), np.maximum(ca, cb), -same), axis=1))
        if not out:
            return np.empty((0, 2), np.int64)
        found = np.concatenate(out)
        if most and len(found):
            found = found[np.lexsort((found[:, 1], found[:, 0], found[:, 4], found[:, 3], found[:, 2]))]
            new = np.flatnonzero(np.concatenate(([True], (found[1:, 2:4] != found[:-1, 2:4]).any(axis=1))))
            place = np.arange(len(found)) - np.repeat(new, np.diff(np.append(new, len(found))))
            found = found[place < most]
        return np.unique(found[:, :2], axis=0)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        p = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            c = b.to_pydict()
            found = []
            for i in range(b.num_rows):
                g = (c["key"][i], c["li"][i], c["ri"][i])
                if g != group:
                    found.append(pairs(rows, group[0] if group else 0))
                    group, rows = g, []
                rows.append((c["rep"][i], c["component"][i], c["n"][i], c["sketch"][i], c["is_left"][i], c["is_right"][i], c["short"][i]))
            yield batch(found)
        yield batch([pairs(rows, group[0] if group else 0)])

    return run


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, are in different components and may be similar."""
    m = members.select("key", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    m = m.withColumn("component", F.coalesce("component", "rep"))
    sizes = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "component")).alias("top")).where("k > 1")
    sizes = sizes.select("key", "m", F.col("top.component").alias("major"), (F.col("m") - F.col("top.c")).alias("rest"))
    m = m.join(sizes, "key").join(sets.select("rep", F.size("set").alias("n"), "sketch", "short"), "rep")
    lb, rb = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    h = F.xxhash64("rep", "key")
    m = m.withColumn("lb", lb).withColumn("rb", rb).withColumn("li", F.pmod(h, F.col("lb")).cast("int")).withColumn("ri", F.pmod(h, F.col("rb")).cast("int"))
    m = m.withColumn("out", F.col("component") != F.col("major"))
    names = ["key", "rep", "component", "n", "sketch", "short"]
    one = m.where("rb = 1").select(*names, F.lit(0).alias("li"), F.lit(0).alias("ri"), F.col("out").alias("is_left"), F.lit(True).alias("is_right"))
    big = m.where("rb > 1")
    left = big.where("out").select(*names, "li", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("ri"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    right = big.select(*names, F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("li"), "ri", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    rows = one.unionByName(left).unionByName(right)
    return rows.repartition("key", "li", "ri").sortWithinPartitions("key", "li", "ri").mapInArrow(_compare(most), "a bigint, b bigint").where("a != b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components of linked vertices."""
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(ends).select(F.col("id").alias("component"), F.col("component").alias("top"))
    known = labels.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    alone = top.join(labels, top["component"] == labels["id"], "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    batch_rows(docs.sparkSession)
    d = columns(docs, "doc_id", "text").withColumn("tkey", F.xxhash64("text"))
    signed = cut(d.mapInArrow(_signed, "doc_id bigint, n bigint, digest binary, tkey bigint, short binary, bands array<bigint>"))
    full = signed.where("digest is not null and doc_id is not null")
    reps = cut(full.groupBy("digest").agg(F.min(F.struct("doc_id", "tkey")).alias("s"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short")).select("digest", F.col("s.doc_id").alias("rep"), F.col("s.tkey").alias("tkey"), "n", "bands", "short"))
    banded = reps.select("rep", F.explode("bands").alias("key"))
    # centres are combined before their shuffle and the join can be split, so a band that very many share is no single task's
    centres = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("s")).where("c > 1")
    members = cut(banded.join(centres.select("key", F.col("s.rep").alias("centre")), "key"))
    votes = members.where("rep != centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("c"))
    first = votes.groupBy("rep").agg(F.max(F.struct("c", "centre")).alias("s")).select(F.col("rep").alias("a"), F.col("s.centre").alias("b"))
    wanted = members.select("rep").distinct().join(reps.select("rep", "tkey", "short"), "rep")
    texts = d.join(wanted, (d["doc_id"] == wanted["rep"]) & (d["tkey"] == wanted["tkey"])).select("rep", "text", "short")
    sets = cut(texts.mapInArrow(_shingle_sets, "rep bigint, set array<bigint>, sketch binary, short binary"))
    links = cut(confirmed(first, sets))
    labels = cut(components(links))
    del first, votes, banded, centres, wanted, texts, links
    for most in ROUNDS:
        forget(docs.sparkSession)
        more = cut(confirmed(_across(members, labels, sets, most), sets))
        if more.isEmpty():
            continue
        labels = cut(_merged(labels, more))
    final = reps.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(final, "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Of rows that are equal in doc_id all stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5_superminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
