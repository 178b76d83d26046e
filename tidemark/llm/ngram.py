"""Language-model scores from an Elias-Fano n-gram trie (operator 10).

The trie has three levels, cut into shards that are files in the shared folder and are
memory-mapped by the tasks that query them; no task, executor or driver holds a level in memory.

* Level 1: the 64-bit hashes of all training words, sorted, as an Elias-Fano sequence; the position
  in it is the word's id. Counts are the differences of a second monotone sequence of running totals.
* Level 2: for each word, its followers. Monotone Elias-Fano pointers give the range of a context;
  follower ids rise inside the range, so ``context * width + follower`` is monotone over the
  shard and is stored as Elias-Fano too. A query looks for the successor of its follower inside its
  context's range. The level holds 16-bit fixed-point discounted log10 probabilities, and for each
  context the share of its mass that its followers take.
* Level 3: the same for each bigram, by its place in its shard of level 2; in the same file.

Smoothing: interpolated absolute discounting over the additively smoothed unigram,
P(w | u) = max(c(u, w) - D, 0) / c(u) + b(u) P1(w), P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
P(x | u, w) = max(c(u, w, x) - D, 0) / c(u, w, any) + b(u, w) P(x | w). The weights b take the mass that
discounting frees, so P sums to one. Nothing is pruned. The context of a document's first word is the
end token, twice for trigrams. ``train`` makes levels 1 and 2, with ``order=3``, as the query does, all three.

Counts: tasks count what they read; words are summed by key (map-side and after the shuffle). N-grams
go to their shard in packed blocks, one from each task for about ``FLUSH`` tokens, and are summed there: one shuffle.
A word's followers are cut into ranges, ``GROUPS`` or more with the number of tokens, so a very common
context is many shards' work.
Writing a shard is idempotent: a task that runs again replaces the file by an equal one.

Defined cases: null, empty or blank text: the end token alone; null doc_id: its text form counts as
empty, so it is held out (crc32 0); no training rows: every token has c = 0, N = 0, V = 0; an
empty table gives no rows; repeated rows each count; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bounded, columns, encoded_words, shared_dir
from .files import read, write

BITS = 5
SHARDS = 1 << BITS
GROUPS = 2
DISCOUNT = 0.75
#: Least counts of what is kept: everything.
MIN_WORD, MIN_PAIR = 1, 1
#: Training tokens of a shard of levels 2 and 3, about; the groups are as many as that takes.
SHARD_TOKENS = 4_000_000
#: Stands for the follower of a bigram at a document's end.
NOTHING = -1
#: Fixed point of log10 probabilities: 0 to -16 in 65,535 steps.
STEP = 16 / 65535
#: The end token: a byte string that no word equals, since words hold no space.
END = b" "
FLUSH = 2_000_000
TRAIN_MOD = 10
_U1 = np.uint64(1)
#: Place of the r-th one in a byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of integers below ``universe`` in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray | None = None, zeros: np.ndarray | None = None):
        self.n, self.universe, self.low, self.high = n, universe, low, high
        self.l = self.low_bits(n, universe)
        if ones is None:
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
            zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - ones
        self.ones, self.zeros = ones, zeros

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // max(n, 1)).bit_length() - 1)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        l = cls.low_bits(n, universe)  # noqa: E741
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            bits = v & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, bits << off)
            over = (off + np.uint64(l)) > 64
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (np.uint64(64) - off[over]))
        pos = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + (universe >> l) + 2 + 63) // 64, np.uint64)
        np.bitwise_or.at(high, pos >> 6, _U1 << (pos & 63).astype(np.uint64))
        return cls(n, universe, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(off == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)))
        return ((self.low[word] >> off) | over) & np.uint64((1 << self.l) - 1)

    @staticmethod
    def _in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th one (from 0) in each word."""
        pos, r = np.zeros(len(w), np.int64), r.copy()
        for width in (32, 16, 8):
            c = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
            go = r >= c
            r -= c * go
            w = np.where(go, w >> np.uint64(width), w)
            pos += width * go
        return pos + _IN_BYTE[(w & np.uint64(255)).astype(np.int64), r]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        cum = self.ones if one else self.zeros
        word = np.searchsorted(cum, k, side="right") - 1
        w = self.high[word]
        return word * 64 + self._in_word(w if one else ~w, k - cum[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        return self._value(i, self._select(i, True))

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def _until(self, at: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero, which is the first at ``at`` or after it; mostly in the same word."""
        word = np.minimum(at >> 6, len(self.high) - 1)
        w = self.high[word]
        w = (w if one else ~w) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((w & (~w + _U1)) - _U1).astype(np.int64)
        far = np.flatnonzero((w == 0) | (at >> 6 != word))
        out[far] = self._select(k[far], one)
        return out

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions i and i + 1."""
        i = np.asarray(i, np.int64)
        at = self._select(i, True)
        return self._value(i, at).astype(np.int64), self._value(i + 1, self._until(at + 1, i + 1, True)).astype(np.int64)

    def find(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of each key (uint64 below universe) in [lo, hi), -1 where it isn't there: successor search in its bucket."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        h = (keys >> np.uint64(self.l)).astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        first, last = start - h, self._until(start, h, False) - h
        if lo is not None:
            first, last = np.maximum(first, lo), np.minimum(last, hi)
        want = keys & np.uint64((1 << self.l) - 1)
        a, b = first, last
        live = np.flatnonzero(a < b)
        a, b = a.copy(), b.copy()
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        at = np.flatnonzero(a < last)
        hit = at[self._low(a[at]) == want[at]]
        out[hit] = a[hit]
        return out


# ---------------------------------------------------------------- shard files


def _ef(arrays: dict[str, np.ndarray], name: str, n: int, universe: int) -> EliasFano:
    return EliasFano(n, universe, *(arrays[f"{name}_{part}"] for part in ("low", "high", "ones", "zeros")))


def _parts(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}_{part}": getattr(ef, part) for part in ("low", "high", "ones", "zeros")}


class Words:
    """Level 1."""

    def __init__(self, where: str, sizes: dict[int, int]):
        self.where = where
        self.base = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(SHARDS)]))).astype(np.int64)
        self.open: dict[int, tuple[EliasFano, EliasFano]] = {}

    def shard(self, s: int) -> tuple[EliasFano, EliasFano]:
        if s not in self.open:
            meta, a = read(f"{self.where}/words/{s}")
            self.open[s] = (_ef(a, "hash", meta["n"], 1 << (64 - BITS)), _ef(a, "total", meta["n"] + 1, meta["total"] + 1))
        return self.open[s]

    def look(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (-1: unknown) and counts of hashes in ascending order."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        shift = np.uint64(64 - BITS)
        edges = np.searchsorted(sorted_hashes >> shift, np.arange(SHARDS + 1, dtype=np.uint64))
        for s in range(SHARDS):
            lo, hi = edges[s], edges[s + 1]
            if lo == hi or self.base[s] == self.base[s + 1]:
                continue
            seq, total = self.shard(s)
            i = seq.find(sorted_hashes[lo:hi] & np.uint64((1 << (64 - BITS)) - 1))
            ok = np.flatnonzero(i >= 0)
            ids[lo + ok] = self.base[s] + i[ok]
            counts[lo + ok] = (total.get(i[ok] + 1) - total.get(i[ok])).astype(np.int64)
        return ids, counts


class Grams:
    """Levels 2 and 3. Shards are opened for a batch and let go, so only pages in use are mapped."""

    def __init__(self, model: dict, base: np.ndarray):
        self.where, self.base, self.groups, self.v = model["where"], base, model["groups"], int(base[-1])
        self.width = self.v // self.groups + 1
        self.there = sorted(model["grams"])

    def shard_of(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Number of the shard of each bigram, -1 where a word is unknown."""
        s = np.searchsorted(self.base, u, side="right") - 1
        return np.where((u >= 0) & (w >= 0), s * self.groups + w // self.width, -1)

    def look(self, contexts: np.ndarray, u: np.ndarray, w: np.ndarray, of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Back-off weights of the words ``contexts`` (ids, ascending) and of the bigrams (u, w); discounted P(w | u), and
        P(x | bigram number ``of``) of trigrams, 0 where there is no such n-gram. Unknown words have the id -1."""
        back, prob, back2, prob3 = np.ones(len(contexts)), np.zeros(len(u)), np.ones(len(u)), np.zeros(len(of))
        shard = self.shard_of(u, w)
        shard3 = np.where(x >= 0, shard[of], -1)
        two, three = np.argsort(shard, kind="stable"), np.argsort(shard3, kind="stable")
        sorted2, sorted3 = shard[two], shard3[three]
        node = np.full(len(u), -1, np.int64)
        edges = np.searchsorted(contexts, self.base)
        for s, g in self.there:
            number = s * self.groups + g
            at, at3 = (o[slice(*np.searchsorted(k, (number, number + 1)))] for o, k in ((two, sorted2), (three, sorted3)))
            lo, hi = edges[s], edges[s + 1]
            if lo == hi and not len(at):
                continue
            meta, a = read(f"{self.where}/grams/{s}-{g}")
            n, n3, k = meta["n"], meta["n3"], meta["contexts"]
            back[lo:hi] -= a["share"][contexts[lo:hi] - self.base[s]] / 65535
            if not len(at):
                continue
            seq, pointer = _ef(a, "next", n, k * self.width), _ef(a, "pointer", k + 1, n + 1)
            own = u[at] - self.base[s]
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            first, last = (np.repeat(x, np.diff(np.append(new, len(own)))) for x in pointer.span(own[new]))
            i = seq.find((own * self.width + (w[at] - g * self.width)).astype(np.uint64), first, last)
            at, i = at[i >= 0], i[i >= 0]
            node[at] = i
            prob[at] = _probs(a["prob"][i])
            if not n3:
                continue
            back2[at] -= a["share3"][i] / 65535
            at3 = at3[node[of[at3]] >= 0]
            if len(at3):
                seq, pointer = _ef(a, "next3", n3, n * self.v), _ef(a, "pointer3", n + 1, n3 + 1)
                own = node[of[at3]]
                i = seq.find((own * self.v + x[at3]).astype(np.uint64), *pointer.span(own))
                prob3[at3[i >= 0]] = _probs(a["prob3"][i[i >= 0]])
        return np.maximum(back, 1e-6), prob, np.maximum(back2, 1e-6), prob3


def _probs(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 65535, 0.0, 10.0 ** (codes * -STEP))


def _shares(at: np.ndarray, prob: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(65535, np.round(np.bincount(at, prob, minlength=n) * 65535)).astype(np.uint16)


def _pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers, byte by byte: the lowest bytes of all, then the next, as far as any are set."""
    sizes = [(int(x.max()).bit_length() + 7) // 8 for x in arrays]
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes() for x, k in zip(arrays, sizes, strict=True)]
    return struct.pack(f"<q{len(sizes)}B", len(arrays[0]), *sizes) + b"".join(planes)


def _unpack(blob: bytes, count: int = 3) -> list[np.ndarray]:
    n, *sizes = struct.unpack_from(f"<q{count}B", blob)
    out, off = [], 8 + count
    for k in sizes:
        x = np.zeros((n, 8), np.uint8)
        x[:, :k] = np.frombuffer(blob, np.uint8, n * k, off).reshape(k, n).T
        out.append(x.reshape(-1).view("<i8"))
        off += n * k
    return out


def _codes(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-16)) / STEP), 0, 65535).astype(np.uint16)


# ---------------------------------------------------------------- training

_END_HASH = xxhash.xxh3_64_intdigest(END)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of a string column in ascending order, the number among them of every token, an end
    after each text, and tokens of each text."""
    ws, number, off = encoded_words(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, [*ws, END]), np.uint64, len(ws) + 1)
    order = np.argsort(h)
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return h[order], place[np.insert(number, off[1:], len(ws))], np.diff(off) + 1


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes and the number of every token, as ``_tokens`` has them, for about FLUSH tokens at a time."""
    held, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        at = np.cumsum([0, *(len(x) for x, _ in held)])
        return h, np.concatenate([place[a:][i] for a, (_, i) in zip(at.tolist(), held, strict=False)])

    for b in bounded(batches):
        h, number, _ = _tokens(b.column("text"))
        held.append((h, number))
        size += len(number)
        if size >= FLUSH:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, number in _gather(batches):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(number, minlength=len(h)))], names=["h", "c"])


def train(docs: DataFrame, order: int = 2) -> dict:
    """Writes the trie of all texts of ``docs`` (column text) to the shared folder, of bigrams or (``order`` 3) trigrams
    too; returns what a query needs."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    batch_rows(spark)
    where = shared_dir(spark) + "/ngram"
    text = columns(docs, "text")

    def write_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        h, c = (table.column(k).to_numpy() for k in ("h", "c"))
        h = h.astype(np.int64).view(np.uint64) & np.uint64((1 << (64 - BITS)) - 1)
        order = np.argsort(h)
        total = np.concatenate(([0], np.cumsum(c[order])))
        hash_, totals = EliasFano.build(h[order], 1 << (64 - BITS)), EliasFano.build(total, int(total[-1]) + 1)
        write(f"{where}/words/{s}", {"n": len(h), "total": int(total[-1])}, _parts("hash", hash_) | _parts("total", totals))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(h)], pa.int64()), "total": pa.array([int(total[-1])], pa.int64())})

    counted = text.mapInArrow(_count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    shards = counted.withColumn("shard", F.shiftrightunsigned("h", 64 - BITS).cast("int")).groupBy("shard").applyInArrow(write_words, "shard int, n bigint, total bigint").collect()
    sizes = {r["shard"]: r["n"] for r in shards}
    model = {"where": where, "sizes": sizes, "V": sum(sizes.values()), "N": sum(r["total"] for r in shards)}

    groups = max(GROUPS, model["N"] // (SHARDS * SHARD_TOKENS) + 1)
    base = Words(where, sizes).base
    v = int(base[-1])
    width = v // groups + 1

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(where, sizes)
        for h, inverse in _gather(batches):
            ids, _ = level.look(h)
            end = int(np.searchsorted(h, _END_HASH))
            before = np.concatenate(([end], inverse[:-1]))  # the token before a document's first is the end of another: the same token
            grams = [(before, inverse, np.full(len(inverse), NOTHING, np.int64))]
            if order == 3:
                last = np.flatnonzero(inverse == end)
                second = np.where(before == end, end, np.concatenate(([end, end], inverse[:-2]))[: len(inverse)])
                grams = [(before[last], inverse[last], np.full(len(last), NOTHING, np.int64)), (second, before, inverse)]
            a, b, x = (np.concatenate(k) for k in zip(*grams, strict=True))
            m = len(h) + 1
            if m < 1 << 20:
                key, c = np.unique((a * m + b) * m + (x + 1), return_counts=True)
                a, b, x = key // (m * m), key // m % m, key % m - 1
            else:
                (a, b, x), c = np.unique(np.stack((a, b, x)), axis=1, return_counts=True)
            u, w, x = ids[a], ids[b], np.where(x < 0, v, ids[x])
            s = np.searchsorted(base, u, side="right") - 1
            shard = s * groups + w // width
            by = np.argsort(shard, kind="stable")
            numbers, starts = np.unique(shard[by], return_index=True)
            key = (u - base[s]) * width + w % width
            blobs = [_pack(np.diff(key[k], prepend=0), x[k], c[k]) for k in np.split(by, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array((numbers // groups).astype(np.int32)), pa.array((numbers % groups).astype(np.int32)), pa.array(blobs, pa.binary())], names=["s", "g", "grams"])

    def write_grams(table: pa.Table) -> pa.Table:
        s, g = table.column("s")[0].as_py(), table.column("g")[0].as_py()
        parts = [_unpack(b) for b in table.column("grams").to_pylist()]
        key, x, c = np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))
        del parts
        k = int(base[s + 1] - base[s])
        by = np.argsort(key * (v + 1) + x, kind="stable") if k * width * (v + 1) < 1 << 63 else np.lexsort((x, key))
        key, x, c = key[by], x[by], c[by]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]))))
        key, x, c = key[new], x[new], np.add.reduceat(c, new)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n, node = len(first), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        real = x < v
        key2 = key[first]
        follow = np.bincount(node[real], c[real], minlength=n)
        # a bigram is counted by what follows it, or by itself at a document's end; the context before a first word is no bigram
        end = Words(where, sizes).look(np.array([_END_HASH], np.uint64))[0][0]
        c2 = np.bincount(node[~real], c[~real], minlength=n) + np.where(key2 % width + g * width == end, 0, follow)
        u = key2 // width
        seen = np.diff(Words(where, sizes).shard(s)[1].get(np.arange(k + 1)).astype(np.int64))
        prob = np.maximum(c2 - DISCOUNT, 0) / seen[u]
        arrays = _parts("next", EliasFano.build(key2, k * width)) | _parts("pointer", EliasFano.build(np.searchsorted(u, np.arange(k + 1)), n + 1))
        arrays |= {"prob": _codes(prob), "share": _shares(u, prob, k)}
        node, x, c = node[real], x[real], c[real]
        if len(node):
            prob3 = (c - DISCOUNT) / follow[node]
            arrays |= _parts("next3", EliasFano.build(node * v + x, n * v)) | _parts("pointer3", EliasFano.build(np.searchsorted(node, np.arange(n + 1)), len(node) + 1))
            arrays |= {"prob3": _codes(prob3), "share3": _shares(node, prob3, n)}
        write(f"{where}/grams/{s}-{g}", {"n": n, "n3": len(node), "contexts": k}, arrays)
        return pa.table({"s": pa.array([s], pa.int32()), "g": pa.array([g], pa.int32()), "n": pa.array([int((c2 > 0).sum())], pa.int64()), "n3": pa.array([len(node)], pa.int64())})

    placed = text.mapInArrow(count_grams, "s int, g int, grams binary")
    made = placed.groupBy("s", "g").applyInArrow(write_grams, "s int, g int, n bigint, n3 bigint").collect()
    return model | {"groups": groups, "grams": [(r["s"], r["g"]) for r in made], "n_pairs": sum(r["n"] for r in made), "n_triples": sum(r["n3"] for r in made)}


# ---------------------------------------------------------------- scoring


class Scorer:
    """Scores token sequences with a trained model."""

    def __init__(self, model: dict):
        self.n, self.v = model["N"], model["V"]
        self.words = Words(model["where"], model["sizes"])
        self.grams = Grams(model, self.words.base)

    def score(self, h: np.ndarray, inverse: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of texts of n tokens each, from what ``_tokens`` gives."""
        ids, counts = self.words.look(h)
        p1 = (counts + 0.1) / (self.n + 0.1 * (self.v + 1))
        end = int(np.searchsorted(h, _END_HASH))
        before = np.concatenate(([end], inverse[:-1]))
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        p = p1[inverse]
        # bigrams of the texts, and the two ends before a first word
        pairs, at = np.unique(np.append(before * len(h) + inverse, end * len(h) + end), return_inverse=True)
        of = np.concatenate(([at[-1]], at[:-2]))
        of[starts] = at[-1]
        at = at[:-1]
        triples, at3 = np.unique(of * len(h) + inverse, return_inverse=True)
        known = np.flatnonzero(ids >= 0)  # their ids rise with the hashes
        weight = np.ones(len(h))
        weight[known], prob, back, prob3 = self.grams.look(ids[known], ids[pairs // len(h)], ids[pairs % len(h)], triples // len(h), ids[triples % len(h)])
        smoothed = prob3[at3] + back[of] * (prob[at] + weight[before] * p)
        add = lambda x: np.add.reduceat(x, starts)
        return add((counts[inverse] > 0).astype(np.int64)), add(np.log10(p)), add(np.log10(smoothed))


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and n_tokens, n_known, train_tokens, base_score, score of every text of ``docs``."""
    batch_rows(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in bounded(batches, 10 << 20):
            scorer = scorer or Scorer(model)
            h, inverse, n = _tokens(b.column(b.schema.get_field_index("text")))
            known, base, full = scorer.score(h, inverse, n)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n), pa.array(known), pa.array(np.full(len(n), model["N"], np.int64)), pa.array(base), pa.array(full)],
                names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(*keep, "text").mapInArrow(run, ddl)


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod TRAIN_MOD is 0."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % TRAIN_MOD == 0


def op10_ngram_trie(spark, sf_dir: str) -> DataFrame:
    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("held_out", held_out())
    return score(docs, train(docs.where(~held_out()), order=3), ["doc_id", "held_out"])
