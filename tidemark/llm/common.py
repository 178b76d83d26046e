"""Helpers that the corpus operators share: words, hashes, shared storage, skew-safe joins.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which is what
``bytes.split()`` yields; UTF-8 keeps those six bytes out of longer characters, so
splitting the encoded text equals splitting its code points.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``bytes.translate`` table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M64 = (1 << 64) - 1
#: Rows in an Arrow batch handed to Python: long texts make the default of 10,000 too heavy.
BATCH_ROWS = 512


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    return (text.translate(LOWER) if lower else text).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, computed once; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_SHINGLE = [np.uint64(xxhash.xxh3_64_intdigest(b"shingle%d" % i) | 1) for i in range(64)]


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every window of k words, in order; fewer words: one hash of the whole sequence."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        acc = np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), seed=n))
        return np.array([acc], np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc = mix64(acc + h[i : n - k + 1 + i] * _SHINGLE[i])
    return acc


def binaries(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded(batches: Iterator[pa.RecordBatch], size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about ``size`` bytes of text each, one row at least."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        part, at = np.cumsum(n, dtype=np.int64) // size, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]:
            if end > at:
                yield b.slice(at, end - at)
            at = end


def encoded_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a string column, the number among them of every word in order, and where each text begins
    and ends in that order. Only distinct words become Python objects."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, off = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0  # white space at the ends makes empty ones
    if not full.all():
        off = np.concatenate(([0], np.cumsum(full)))[off]
        values = values.filter(pa.array(full))
    found = values.dictionary_encode()
    return binaries(found.dictionary), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), off


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``; a temporary one is set only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends here, executors may be lost after it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Lets the cleaner delete shuffle files and checkpoints of frames that are no longer referred to.

    It acts only on what the driver's garbage collection has found, which may be long after disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of a table, however many others it has; a missing one is an error."""
    kinds = {"doc_id": "bigint", "item_id": "bigint", "page_id": "bigint", "conv_id": "bigint", "turn": "bigint"}
    if missing := [n for n in names if n not in docs.columns]:
        raise ValueError(f"columns {missing} are missing")
    return docs.select(*[F.col(f"`{n}`").cast(kinds.get(n, "string")).alias(n) for n in names])


def hidden(docs: DataFrame, *shown: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns _0, _1, ... and the ``shown`` ones, so that no name of its own can clash with an operator's,
    and what takes the columns of a result back to their names, dropping all others."""
    names = docs.columns
    if missing := [n for n in shown if n not in names]:
        raise ValueError(f"columns {missing} are missing")
    inner = [n if n in shown else f"_{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the texts that one Arrow batch carries to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
