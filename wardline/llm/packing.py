"""Best-fit packing of token sequences as vector bin packing.

An item is a piece of a document, with the vector (tokens, 1 document, tokens**2 attention cost); a bin has a capacity in
each dimension. The vector depends on the piece's length alone, so the driver packs a histogram of lengths, of as many
entries as the token capacity at most, and never sees an item. The bin-centric rule opens a bin with the longest length that
is left and fills it with the length of best score among those that meet every constraint: the largest weighted dot-product
of item and residual, or the smallest weighted norm of what remains. A pattern so found is repeated while its lengths last,
so there are no more patterns than lengths. Items are then dealt to the bins by their rank among pieces of the same
length, which is counted in salted groups; no length, however frequent, meets in one task.

Cases: a null or empty text is its end token alone. Longer documents are cut at the capacity and the last piece may be
shorter. Rows that repeat a doc_id are packed once each. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, joined, released, small_batches, tidied, written
from .word_bpe import WordBpe, spread

TOKENS, END = 4096, 1
#: About the most pieces of one length that a task ranks.
SALT_ROWS = 200_000
#: Most distinct words whose ids a worker keeps from one part of its texts to the next.
MEMORY = 400_000
#: Bytes of text that are tokenized together.
PART = 8 << 20
VOCABULARY = "word_bpe_49k.json"
SPACE, NEWLINE = 32, 10


class Words:
    """Ids of whole texts. The tokenizer never joins what a space or newline divides, so each distinct word is looked up once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the executor's to share out
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), WordBpe(path)
        self.marks = {ord(c): np.array(self._library([c])[0], dtype=np.int32) for c in ",."}
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.count = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _library(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Adds the ids of words that aren't known yet. A word may have the space behind it that ends it."""
        if len(self.known) + len(words) > MEMORY:
            self._forget()
        start, data = _layout(words)
        size = np.diff(start)
        begin = start[:-1]
        size = size - (data[np.maximum(start[1:] - 1, 0)] == SPACE) if len(size) else size
        at, count, flat = self.plain.encode(data, begin, size, self.marks)
        rest = np.ones(len(size), dtype=bool)
        rest[at] = False
        rest = np.flatnonzero(rest)
        raw = data.tobytes()
        texts = [raw[i : i + n].decode() for i, n in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)]
        counts, ids = [count], [flat]
        for k in range(0, len(texts), 4096):
            own = self._library(texts[k : k + 4096])
            counts.append(np.array([len(x) for x in own], dtype=np.int64))
            ids.append(np.fromiter(chain.from_iterable(own), dtype=np.uint32))
        order = pa.array(np.concatenate([at, rest]))
        self.known = pa.concat_arrays([self.known, words.take(order)])
        self.count = np.concatenate([self.count, *counts])
        self.flat = np.concatenate([self.flat, *ids])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, the number of each text's)."""
        bounds, data = _layout(texts)
        data = np.where(data == NEWLINE, np.uint8(SPACE), data)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:] = data == SPACE
        cut[bounds] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        offsets = pa.py_buffer(cuts.astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct, index = words.dictionary, words.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.known)
        if place.null_count:
            held = len(self.known)
            fresh = distinct.filter(place.is_null())
            self._learn(fresh)
            if len(self.known) < held + len(fresh):  # what was known has been dropped
                self._forget()
                self._learn(distinct)
            place = pc.index_in(distinct, value_set=self.known)
        place = place.to_numpy()
        start = (np.cumsum(self.count) - self.count)[place][index]
        count = self.count[place][index]
        before = np.concatenate([[0], np.cumsum(count)])
        return self.flat[spread(start, count)], np.diff(before[np.searchsorted(cuts, bounds)])


def _layout(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins and the last one ends, and the bytes of all."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if not len(offsets) or values.buffers()[2] is None:
        return np.zeros(len(values) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _pieces(path: str, tokens: int, end: int):
    def cut_up(words, docs, texts):
        ids, count = words.ids(texts)
        ids = np.insert(ids, np.cumsum(count), end).astype("<u4")
        count = count + 1
        parts = -(-count // tokens)
        first = np.cumsum(count) - count
        piece = spread(np.zeros_like(parts), parts)
        at = piece * tokens
        length = np.minimum(np.repeat(count, parts) - at, tokens)
        whole = memoryview(ids).cast("B")
        crc = [zlib.crc32(whole[4 * a : 4 * (a + n)]) for a, n in zip((np.repeat(first, parts) + at).tolist(), length.tolist(), strict=True)]
        return batch_of(PIECE, [docs.take(pa.array(np.repeat(np.arange(len(count)), parts))), piece, at, length, crc])

    def run(batches):
        released()
        words = Words(path)
        released()  # what reading the vocabulary took
        for batch in joined(batches, PART):
            docs, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            yield cut_up(words, docs, texts.fill_null(b""))

    return run


def cut(docs: DataFrame, tokens: int = TOKENS, path: str | None = None, end: int = END) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidied(_pieces(path or tokenizer_path(), tokens, end)), PIECE)


def patterns(counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "dot") -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, uses in each bin)]) that pack ``counts`` items of each length.

    rule: "dot" takes the largest weighted dot-product of item and residual, "norm" the smallest weighted norm of the residual
    that is left. Both are measured in parts of the capacities.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[x] for x in lengths], dtype=np.int64)
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.int64)
    vectors = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    if len(lengths) and (vectors > capacity).any():
        raise ValueError("an item is larger than a bin")
    scaled, weights = vectors / capacity, np.asarray(weights, dtype=np.float64)
    found = []
    while (some := np.flatnonzero(left)).size:
        used, rest = {int(some[-1]): 1}, capacity - vectors[some[-1]]
        while True:
            free = left.copy()
            for k, n in used.items():
                free[k] -= n
            fits = np.flatnonzero((free > 0) & (vectors <= rest).all(axis=1))
            if not fits.size:
                break
            room = rest / capacity
            score = (weights * scaled[fits] * room).sum(axis=1) if rule == "dot" else -(weights * (room - scaled[fits]) ** 2).sum(axis=1)
            k = int(fits[len(fits) - 1 - np.argmax(score[::-1])])
            used[k] = used.get(k, 0) + 1
            rest = rest - vectors[k]
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        found.append((times, [(int(lengths[k]), n) for k, n in used.items()]))
    return found


def _places(found):
    """For each length, sorted by it and the first rank: key columns and (uses, first sequence, first offset)."""
    taken, rows, first = {}, [], 0
    for times, own in found:
        offset = 0
        for length, uses in own:
            rows.append((length, taken.get(length, 0), uses, first, offset))
            taken[length] = taken.get(length, 0) + uses * times
            offset += length * uses
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PLACED = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _place(table: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
                at = np.searchsorted(table[:, 0] << 44 | table[:, 1], length << 44 | rank, side="right") - 1
                own = table[at]
                over = rank - own[:, 1]
                yield batch_of(PLACED, [*(batch.column(batch.schema.get_field_index(f.name)) for f in PIECE.fields), own[:, 3] + over // own[:, 2], own[:, 4] + over % own[:, 2] * length])

    return run


def pack(docs: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm", path: str | None = None, end: int = END) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset there. ``documents`` and ``attention`` cap a sequence's
    pieces and sum of squared lengths; left out, they are what the token capacity implies."""
    cut_up = written(cut(docs, tokens, path, end), "pieces")
    counts = {r.length: r["count"] for r in cut_up.groupBy("length").count().collect()}
    found = patterns(counts, tokens, documents, attention, weights, rule)
    salts = max(64, -(-max(counts.values(), default=0) // SALT_ROWS))
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1)
    placed = ranked.join(starts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).select(*PIECE.names, (F.col("first") + F.col("own")).cast("long").alias("rank"))
    return placed.mapInArrow(_place(_places(found)), PLACED)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces."""
    return pack(docs)
