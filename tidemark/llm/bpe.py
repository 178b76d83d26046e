"""Byte-level BPE encoding and decoding (operator 9).

Ranked merges are folded over the bytes of distinct words by Spark's higher-order
functions with the ranks as a literal map (``fold_merges``): each step joins the leftmost
adjacent pair of least rank, until no pair has a rank. The literal is an array of small maps
chosen by CRC, since looking a key up in one map of 50,000 entries takes time in proportion
to its size; the expression holds it once. A step looks up only the two pairs beside the merge, so a
word of n bytes takes about 3 n lookups. Decoding concatenates the binary pieces of the ids. Words of more than
``FOLD_BYTES`` bytes are merged with a heap, in the same order, since the fold's time grows with the square of the length.

A corpus has too many distinct words to join every word of every document to their encodings
(the shuffle alone would be several times the input) or to broadcast them. So only distinct words
are shuffled: tasks pass on the distinct words of what they read, each is folded once, and the
ids go to hash-sharded sorted files in the shared folder (``files``), where the tasks that encode
documents look up their distinct words batch by batch.

A document is cut before every space that follows another character than white space. No
match of the pattern reaches over such a place, so parts are matched alone, once for each
distinct part. The pattern must have that property, as those of GPT-like tokenizers do.

Defined cases: null and empty text: no ids, digests of the empty string; repeated rows each give a row; an empty table gives no rows; further columns are ignored, and those kept may have any names but the outputs'.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, binaries, bounded, columns, cut, ragged, shared_dir, small_batches
from .files import WordTable, write_words

#: Distinct parts that a task holds.
CACHE_PARTS = 400_000
#: Longer words are merged with a heap: the fold's time grows with the square of the length.
FOLD_BYTES = 1024
BUCKETS = 1 << 14
#: Bits of a place in a word, and of a rank.
BITS = 21
NO_RANK = (1 << BITS) - 1
#: What ``encode`` can return of a text.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"}
_CUT = re.compile(r"(?<=\S) ")
#: A space after white space, which ``_CUT`` doesn't cut at, as an RE2 pattern.
SPACED = "[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_pieces(path: str) -> list[bytes]:
    """Pieces by id."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return pieces


def _let(value: Column, body) -> Column:
    """Binds a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<string,int>>, folded to a literal by the optimizer; bytes are written as Latin-1 characters."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, r in ranks.items():
        s = piece.decode("latin-1")
        maps[zlib.crc32(s.encode("utf-8")) % BUCKETS][s] = r
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int> of ids for a binary column of words of less than 2 ** BITS bytes, by higher-order functions only.

    The state has an item for every part: the rank of the pair that it begins, its start and its end, packed into one
    integer, so that the least item is the leftmost pair of least rank. The last part begins no pair."""
    none = F.array().cast("array<int>")
    low = F.lit((1 << BITS) - 1)

    def with_table(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.try_element_at(F.get(table, F.crc32(piece.cast("binary")) % BUCKETS), piece)

        def ids(w: Column) -> Column:
            n = F.length(w)
            begin = lambda x: F.shiftright(x, BITS).bitwiseAND(low).cast("int")
            end = lambda x: x.bitwiseAND(low).cast("int")
            piece = lambda a, b: F.substr(w, a + 1, b - a)
            item = lambda r, a, b: F.shiftleft(F.coalesce(r, F.lit(NO_RANK)).cast("bigint"), 2 * BITS) + F.shiftleft(a.cast("bigint"), BITS) + b

            def step(e: Column, _: Column) -> Column:
                def merged(i: Column) -> Column:
                    at = lambda k: F.get(e, i + k)
                    joined = item(rank(piece(begin(at(0)), end(at(2)))), begin(at(0)), end(at(1)))
                    left = item(rank(piece(begin(at(-1)), end(at(1)))), begin(at(-1)), end(at(-1)))
                    return F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.when(j > i, F.get(e, j + 1)).when(j == i, joined).when(j == i - 1, left).otherwise(F.get(e, j)))

                placed = F.transform(e, lambda x, i: F.shiftleft(F.shiftright(x, 2 * BITS), 2 * BITS) + i)
                return F.when(F.array_min(e) >= F.lit(NO_RANK << 2 * BITS), e).otherwise(_let(end(F.array_min(placed)), merged))

            start = F.transform(F.sequence(F.lit(0), n - 1), lambda j: item(F.when(j < n - 1, rank(F.substr(w, j + 1, F.lit(2)))), j, j + 1))
            fold = F.aggregate(F.sequence(F.lit(2), n), start, step, lambda e: F.transform(e, lambda x: rank(piece(begin(x), end(x)))))
            return F.when(n == 0, none).otherwise(_let(rank(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold)))

        return _let(F.decode(word, "ISO-8859-1"), ids)

    return _let(rank_literal(ranks), with_table)


def merge_long(words: DataFrame, path: str) -> DataFrame:
    """word and ids of words that the fold, whose time grows with the square of the length, isn't for: a heap of pairs."""

    def ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
        n = len(word)
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [word[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranks.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[after[i]])))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has grown or gone
            part[i], part[j], after[i] = part[i] + part[j], b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            push(before[i])
        return [ranks[word]] if word in ranks else [ranks[p] for p in part if p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        for b in small_batches(batches, 16):
            ranks = ranks or read_ranks(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids(w, ranks) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word binary, ids array<int>")


def parts(text: str) -> list[str]:
    """The text cut at the spaces that follow another character than white space, without those spaces."""
    return _CUT.split(text)


def encoded_parts(texts: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """The first part of every text; the distinct other parts; the number of every part among those, -1 for a first
    one; and where each text begins and ends in that order."""
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
    if odd.any():
        order = np.argsort(np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd))))
        split = pa.concat_arrays([split.filter(pa.array(~odd)), pa.array([parts(t) for t in texts.filter(pa.array(odd)).to_pylist()], split.type)]).take(pa.array(order))
    values, off = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    first = np.zeros(len(values), bool)
    first[off[:-1]] = True
    found = values.filter(pa.array(~first)).dictionary_encode()
    number = np.full(len(values), -1, np.int64)
    number[~first] = found.indices.to_numpy(zero_copy_only=False)
    return values.filter(pa.array(first)).to_pylist(), found.dictionary.to_pylist(), number, off


def _matcher(pattern: str) -> Callable[[str], list[str]]:
    """Matches in a part that a space precedes. Letters are one match in every pattern of the kind."""
    find = regex.compile(pattern).findall
    plain = find(" azAZ") == [" azAZ"]
    return lambda p: [" " + p] if plain and p.isascii() and p.isalpha() and p.islower() else find(" " + p)


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word (binary): every match of the pattern in any text, once."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many live objects, none of them in a cycle
        find, matches = regex.compile(pattern).findall, _matcher(pattern)
        heads, seen = set(), set()

        def out() -> pa.RecordBatch:
            found = set(chain.from_iterable(map(find, heads)))
            found.update(chain.from_iterable(map(matches, seen)))
            heads.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()).cast(pa.binary())], names=["word"])

        for b in bounded(batches):
            first, rest, _, _ = encoded_parts(b.column("text"))
            heads.update(first)
            seen.update(rest)
            if len(seen) + len(heads) > CACHE_PARTS:
                yield out()
        yield out()

    return columns(docs, "text").mapInArrow(run, "word binary").distinct()


class Encoder:
    """Ids of texts, from a written word table. Parts that it has met are numbered."""

    def __init__(self, table: dict, pattern: str):
        self.words, self.find, self.matches = WordTable(table), regex.compile(pattern).findall, _matcher(pattern)
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _meet(self, found: list[list[str]]) -> tuple[np.ndarray, ...]:
        """ids, starts and sizes of parts, given their words."""
        flat = list(chain.from_iterable(found))
        place = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids, sizes = self.words.look([w.encode() for w in place])
        which = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        out = ids[ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
        total = np.concatenate(([0], np.cumsum(sizes[which])))
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        return out, total[at[:-1]], np.diff(total[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end."""
        heads, rest, number, off = encoded_parts(texts)
        if len(self.known) > CACHE_PARTS:
            self.__init__(self.words.table, self.find.__self__.pattern)
        known = self.known
        new = [p for p in rest if p not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        ids, start, size = self._meet([*map(self.matches, new), *map(self.find, heads)])
        n = len(self.start)
        self.start, self.size = (np.concatenate((a, b[: len(new)])) for a, b in ((self.start, start + len(self.ids)), (self.size, size)))
        flat = np.concatenate((self.ids, ids))
        sequence = np.full(len(number), -1, np.int64)
        inner = number >= 0
        sequence[inner] = np.fromiter(map(known.__getitem__, rest), np.int64, len(rest))[number[inner]]
        sequence[off[:-1]] = n + len(new) + np.arange(len(heads))
        starts, sizes = np.concatenate((self.start, start[len(new) :] + len(self.ids))), np.concatenate((self.size, size[len(new) :]))
        self.ids = flat[: len(self.ids) + int(size[: len(new)].sum())]
        starts, sizes = starts[sequence], sizes[sequence]
        return flat[ragged(starts, sizes)], np.concatenate(([0], np.cumsum(sizes)))[off]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, outputs: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``outputs`` (of OUTPUTS, ids by default) of every whole text; digests are SHA-256 in hex,
    of the decimal ids joined by a space and of the decoded bytes; round_trip: whether those are the text's."""
    spark = docs.sparkSession
    keep, outputs = ["doc_id"] if keep is None else keep, outputs or ["ids"]
    if clash := set(keep) & set(outputs):
        raise ValueError(f"columns {sorted(clash)} are outputs")
    words = cut(distinct_words(docs, pattern))
    short = F.length("word") <= FOLD_BYTES
    folded = words.where(short).select("word", fold_merges(F.col("word"), read_ranks(path)).alias("ids"))
    table = write_words(folded.unionByName(merge_long(words.where(~short), path)), f"{shared_dir(spark)}/bpe", words.count())
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    own = [f"k{i}" for i in range(len(keep))]
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), *(f"{c} {OUTPUTS[c]}" for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder, pieces = Encoder(table, pattern), read_pieces(path)
        decimal = [str(i) for i in range(len(pieces))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in bounded(batches):
            text = b.column(len(own))
            ids, off = encoder.encode(text)
            each = [ids[a:z].tolist() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] if set(outputs) - {"ids", "n_tokens"} else []
            decoded = [decode_ids(x, pieces) for x in each]
            made = {
                "ids": lambda: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                "n_tokens": lambda: pa.array(np.diff(off)),
                "ids_sha256": lambda: pa.array([sha(" ".join(map(decimal.__getitem__, x)).encode()) for x in each], pa.string()),
                "decoded_sha256": lambda: pa.array([sha(x) for x in decoded], pa.string()),
                "round_trip": lambda: pa.array([x == (t or b"") for x, t in zip(decoded, binaries(text), strict=True)], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *(made[c]() for c in outputs)], names=[*own, *outputs])

    return source.mapInArrow(run, ddl).toDF(*keep, *outputs)


def decode_ids(ids: list[int], pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded (binary): the pieces of ids, concatenated; an id without a piece fails the task, null ids decode to nothing."""
    if "decoded" in encoded.columns:
        raise ValueError("there is a column decoded")
    names = encoded.columns
    plain = encoded.toDF(*[f"k{i}" for i in range(len(names))])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_pieces(path)
        for b in small_batches(batches, 64):
            text = [decode_ids(x or [], pieces) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], names=[*b.schema.names, "decoded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", decoded binary"
    return plain.mapInArrow(run, ddl).toDF(*names, "decoded")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, outputs=["n_tokens", "ids_sha256", "decoded_sha256"])
