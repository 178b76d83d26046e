"""Token counts without token ids (operator 6).

Pieces are counted once for each distinct pre-token of the corpus and joined to every document's
pre-token frequencies; the sum is the document's token count and no id list is kept.

A pre-token here is a maximal run without ASCII white space. For the given tokenizer that
is exact: its normaliser turns white space into spaces and composes or lower-cases
characters inside a run only, its splitter drops white space, and the special strings it
recognises hold none, so nothing it does reaches over white space. Runs that hold other
white space (no-break space and the like) go to the library whole.

Only distinct pre-tokens are shuffled: tasks pass on the distinct ones of what they read, each is
counted once, and the counts go to hash-sharded sorted files in the shared folder (``files``). The
tasks that hold the documents' frequencies join them to those files batch by batch, by binary
search. So neither rows for each document and pre-token nor the counts of all pre-tokens move, and
memory doesn't grow with the vocabulary.

Defined cases: null or empty text: 0 bytes, 0 tokens; repeated rows each give a row; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch_rows, bounded, columns, cut, encoded_words, shared_dir, small_batches
from .files import WordTable, write_words

#: Distinct pre-tokens that a task holds.
CACHE_PRETOKENS = 400_000


def distinct_pretokens(docs: DataFrame) -> DataFrame:
    """word (binary): every pre-token of any text, once."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in bounded(batches):
            seen.update(encoded_words(b.column("text"))[0])
            if len(seen) > CACHE_PRETOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], names=["word"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], names=["word"])

    return columns(docs, "text").mapInArrow(run, "word binary").distinct()


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """word and ids: the number of its pieces, as an array of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = None
        for b in small_batches(batches, 4096):
            if tokenizer is None:
                tokenizer = Tokenizer.from_file(path)
                tokenizer.no_truncation()
                tokenizer.no_padding()
            encoded = tokenizer.encode_batch([w.decode() for w in b.column(0).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[len(e.ids)] for e in encoded], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word binary, ids array<int>")


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; ``path``: a tokenizers .json file on all nodes."""
    words = cut(distinct_pretokens(docs))
    table = write_words(count_pieces(words, path), f"{shared_dir(docs.sparkSession)}/pieces", words.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = WordTable(table), {}
        for b in bounded(batches):
            text = b.column("text")
            words, number, off = encoded_words(text)
            if len(known) > CACHE_PRETOKENS:
                known.clear()
            if new := [w for w in words if w not in known]:
                known.update(zip(new, pieces.look(new)[0].tolist(), strict=True))
            counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            # frequencies: number of document and pre-token, and how often it occurs there
            doc = np.repeat(np.arange(len(text)), np.diff(off))
            pair, times = np.unique(doc * max(1, len(words)) + number, return_counts=True)
            n = np.zeros(len(text), np.int64)
            np.add.at(n, pair // max(1, len(words)), times * counts[pair % max(1, len(words))])
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > max_tokens)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
