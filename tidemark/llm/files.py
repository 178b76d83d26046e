"""Arrays and word tables as files in the shared folder.

A file holds named arrays behind a JSON head and is memory-mapped by the tasks that read it. Writing
is idempotent: a task that runs again replaces the file by an equal one.

A word table maps distinct words to lists of integers. It is cut into shards by the upper bits of
the words' hash, each sorted by that hash, so a task looks up a batch of words by binary search and
holds no part of the table beyond the pages in use. Words are told apart by 128 bits.
"""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged

#: Words in a shard at most, about, and the least number of shards (a power of two).
SHARD_WORDS = 2_000_000
LEAST_SHARDS = 32
#: Seed of Spark's xxhash64.
SEED = 42


def write(path: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    head, off = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), off)
        off += -(-x.nbytes // 8) * 8
    text = json.dumps(meta | {"arrays": head}).encode()
    text += b" " * (-len(text) % 8)
    temp = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(len(text).to_bytes(8, "little"))
        f.write(text)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * (-x.nbytes % 8))
    fs.move(temp, at)


@functools.cache
def _copied(path: str) -> pa.Buffer:
    """A file of a remote store, mapped from a copy that has no name any more and goes with the worker."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile(delete=False) as t, fs.open_input_stream(at) as f:
        while part := f.read(1 << 22):
            t.write(part)
    try:
        return pa.memory_map(t.name).read_buffer()
    finally:
        os.unlink(t.name)


def read(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """What ``write`` was given, as memory-mapped arrays."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    buf = pa.memory_map(at).read_buffer() if isinstance(fs, pyarrow.fs.LocalFileSystem) else _copied(path)
    size = int.from_bytes(buf[:8].to_pybytes(), "little")
    meta = json.loads(buf[8 : 8 + size].to_pybytes())
    return meta, {name: np.frombuffer(buf, np.dtype(kind), n, 8 + size + off) for name, (kind, n, off) in meta["arrays"].items()}


def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.fromiter((digest(w) for w in words), np.uint64, len(words)) for digest in (functools.partial(xxhash.xxh64_intdigest, seed=SEED), xxhash.xxh3_64_intdigest))


def write_words(table: DataFrame, where: str, n: int) -> dict:
    """Writes n rows of columns word (binary, distinct) and ids (array<int>) under ``where``; returns what ``WordTable`` needs."""
    bits = (max(LEAST_SHARDS, -(-n // SHARD_WORDS)) - 1).bit_length()

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        s, ids = rows.column("shard")[0].as_py(), rows.column("ids").combine_chunks()
        hi, lo = _keys(rows.column("word").to_pylist())
        order = np.lexsort((lo, hi))
        ids = ids.take(pa.array(order))
        off = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        write(f"{where}/{s}", {"n": len(order)}, {"hi": hi[order], "lo": lo[order], "off": off, "ids": ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)})
        return pa.table({"shard": pa.array([s], pa.int32())})

    placed = table.select("word", "ids", F.shiftrightunsigned(F.xxhash64("word"), 64 - bits).cast("int").alias("shard"))
    made = placed.groupBy("shard").applyInArrow(shard, "shard int").collect()
    return {"where": where, "bits": bits, "n": n, "shards": sorted(r["shard"] for r in made)}


class WordTable:
    """Looks words up in a written table; a word that isn't there is an error."""

    def __init__(self, table: dict):
        self.table, self.where, self.bits, self.there = table, table["where"], table["bits"], set(table["shards"])

    def _places(self, words: list[bytes]):
        """Arrays of a shard, positions in it, and the words' numbers, shard by shard."""
        hi, lo = _keys(words)
        order = np.argsort(hi, kind="stable")
        hi, lo = hi[order], lo[order]
        shards = (hi >> np.uint64(64 - self.bits)).astype(np.int64)
        numbers, starts = np.unique(shards, return_index=True)
        for s, a, b in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hi)], strict=bool(words)):
            if s not in self.there:
                raise KeyError(words[order[a]])
            _, x = read(f"{self.where}/{s}")
            at = np.searchsorted(x["hi"], hi[a:b])
            last = len(x["hi"]) - 1
            for i in np.flatnonzero((x["hi"][np.minimum(at, last)] != hi[a:b]) | (x["lo"][np.minimum(at, last)] != lo[a:b])).tolist():
                while at[i] <= last and x["hi"][at[i]] == hi[a + i] and x["lo"][at[i]] != lo[a + i]:
                    at[i] += 1
                if at[i] > last or x["hi"][at[i]] != hi[a + i]:
                    raise KeyError(words[order[a + i]])
            yield x, at, order[a:b]

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all words, one word after another, and how many each has."""
        sizes, found = np.zeros(len(words), np.int64), []
        for x, at, which in self._places(words):
            first = x["off"][at]
            sizes[which] = x["off"][at + 1] - first
            found.append((x["ids"], first, which))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for ids, first, which in found:
            out[ragged(starts[which], sizes[which])] = ids[ragged(first, sizes[which])]
        return out, sizes
