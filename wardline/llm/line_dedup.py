"""Line dedup. Two Bloom filters, for once-seen and twice-seen line hashes, pick the lines that may repeat; only those
are shuffled, as 128-bit digests, to be counted exactly and to choose the occurrence that stays.

Pass 1 sends 32-bit fingerprints, packed by segment of the hash space and unique in each task. Each segment builds its
once-seen filter, and from the fingerprints that hit it the twice-seen filter. The twice-seen filters of all segments are
broadcast when they take no more than BROADCAST_BYTES. Beyond that the lines' digests are written once, apart for each slice of
segments whose filters take that much, and slice after slice is tested; so at any size suspected lines alone are shuffled, and
what is broadcast at once is bounded. (The table of digests has a file for each task and slice.) Pass 2 sends the suspected lines'
digests; counting is pre-aggregated and in two steps, first by (digest, doc_id). A line held by very many documents finds its count
by a broadcast of such lines, which are few, so it meets no single task. Texts travel only if they lose lines and these can't be
broadcast.

Digests are 128-bit XXH3; unequal keys would share one with a chance of n*n/2**129.

Cases: a null or empty text is one empty line. A line repeated in one document counts once for it. Rows that repeat a
doc_id count as one document. Rows with a null doc_id count for no line and keep theirs. An empty table gives an empty
table. Other columns stay untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, attached, batch_of, column, discarded, estimated_bytes, extended, free_name, matched, pieces, raw_text, tidied, written

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\x0b\x0c\r"
SEGMENT_BYTES, ONCE_BITS, TWICE_BITS, PROBES = 8 << 20, 12, 16, 4
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points."""
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least


def digests(text: bytes | None, least: int) -> list[bytes | None]:
    """For each line its key's digest; None for a short key."""
    return [xxhash.xxh3_128_digest(k) if long_enough(k := line_key(x), least) else None for x in (text or b"").split(b"\n")]


def positions(marks: np.ndarray, log_bits) -> np.ndarray:
    """PROBES bit positions for each 32-bit mark, in a filter of 2**log_bits bits."""
    mixed = (marks.astype(np.uint64) + np.uint64(1))[:, None] * ODD[None, :]
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD[1]
    return mixed >> (np.uint64(64) - np.asarray(log_bits, dtype=np.uint64).reshape(-1, 1))


def hit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, (at >> np.uint64(3)).ravel(), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)).ravel())


def log_bits(count: int, each: int) -> int:
    return max(6, int(count * each - 1).bit_length())


PACKED = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("marks", T.BinaryType()), T.StructField("again", T.BinaryType())])
FILTER = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("log_bits", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _split(digest: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and 32-bit mark of each digest (rows of two uint64)."""
    return (digest[:, 0] % np.uint64(segments)).astype(np.int64), (digest[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _marks(least: int, segments: int):
    def run(batches):
        for batch in pieces(batches):
            found = [d for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True) if doc is not None for d in {*digests(text, least)} if d]
            if not found:
                continue
            segment, mark = _split(np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2), segments)
            both, counts = np.unique(segment.astype(np.uint64) << np.uint64(32) | mark, return_counts=True)
            segment, mark = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
            names, starts = np.unique(segment, return_index=True)
            ends = [*starts[1:], len(both)]
            yield batch_of(PACKED, [names.astype(np.int32), [mark[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], [mark[a:b][counts[a:b] > 1].tobytes() for a, b in zip(starts, ends, strict=True)]])

    return run


def _filters(table: pa.Table) -> pa.Table:
    """The twice-seen filter of one segment, built by way of its once-seen filter."""
    marks = [np.frombuffer(x, dtype=np.uint32) for x in table.column("marks").to_pylist()]
    size = log_bits(sum(map(len, marks)), ONCE_BITS)
    once, suspected = np.zeros(1 << size - 3, dtype=np.uint8), [np.frombuffer(x, dtype=np.uint32) for x in table.column("again").to_pylist()]
    for own in marks:
        at = positions(own, size)
        suspected.append(own[hit(once, at)])
        put(once, at)
    twice = np.unique(np.concatenate(suspected))
    size = log_bits(len(twice), TWICE_BITS)
    bits = np.zeros(1 << size - 3, dtype=np.uint8)
    put(bits, positions(twice, size))
    rows = [[table.column("segment")[0].as_py()], [size], [bits.tobytes()]] if len(twice) else [[], [], []]
    return pa.Table.from_batches([batch_of(FILTER, rows)])


def repeat_filters(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """The twice-seen filters by segment, and the number of segments, which follows the input's size."""
    segments = max(8, min(1 << 20, -(-estimated_bytes(docs) // SEGMENT_BYTES)))
    packed = raw_text(docs).mapInArrow(tidied(_marks(min_chars, segments)), PACKED)
    return packed.groupBy("segment").applyInArrow(_filters, FILTER), segments


SUSPECT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc_id", T.LongType())])


HASHED = T.StructType([T.StructField("slice", T.IntegerType()), *SUSPECT.fields])


def _hashed(least: int):
    """The distinct digests of each batch's documents, with their doc_ids, as arrays."""

    def run(batches):
        for batch in pieces(batches):
            own, found = [], []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                if doc is not None:
                    new = [d for d in {*digests(text, least)} if d]
                    found += new
                    own += [doc] * len(new)
            if found:
                yield np.array(own, dtype=np.int64), found

    return run


def _sliced(least: int, segments: int, bounds: np.ndarray):
    """All digests with the slice of segments that each belongs to."""

    def run(batches):
        for own, found in _hashed(least)(batches):
            segment, _ = _split(np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2), segments)
            yield batch_of(HASHED, [np.searchsorted(bounds, segment, side="right").astype(np.int32), found, own])

    return run


def _suspected(found: list[bytes], segments: int, filters: tuple) -> np.ndarray:
    """The rows of ``found`` that the twice-seen filters of these segments let through."""
    start, size, bits = filters
    segment, mark = _split(np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2), segments)
    rows = np.flatnonzero(size[segment] > 0)
    own = segment[rows]
    at = positions(mark[rows], size[own]) + start[own].astype(np.uint64)[:, None]
    return rows[hit(bits, at)]


def _tested(read, segments: int, shared):
    def run(batches):
        for own, found in read(batches):
            rows = _suspected(found, segments, shared.value)
            yield batch_of(SUSPECT, [[found[i] for i in rows], own[rows]])

    return run


def _read_digests(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.column(1).to_numpy(), column(batch, "digest")


def _held(spark, filters: DataFrame, segments: int):
    """The filters as a broadcast: where each segment's bits begin, their number's logarithm, and the bits."""
    start, size, bits = np.zeros(segments, dtype=np.int64), np.zeros(segments, dtype=np.int64), bytearray()
    for row in filters.toLocalIterator():
        start[row.segment], size[row.segment] = 8 * len(bits), row.log_bits
        bits += row.bits
    return spark.sparkContext.broadcast((start, size, np.frombuffer(bytes(bits), dtype=np.uint8)))


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(digest, doc_id) of the lines that the twice-seen filters let through, once for each document. A written table."""
    spark = docs.sparkSession
    filters, segments = repeat_filters(docs, min_chars)
    filters = written(filters, "line-filters")
    # Slices of consecutive segments whose filters take BROADCAST_BYTES at most, by their average.
    held = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)), F.coalesce(F.max(F.length("bits")), F.lit(0))).first()
    slices = max(1, min(segments, -(-held[0] // max(1, BROADCAST_BYTES - held[1]))))
    if slices == 1:
        shared = _held(spark, filters, segments)
        out = written(raw_text(docs).mapInArrow(tidied(_tested(_hashed(min_chars), segments, shared)), SUSPECT), "line-suspects")
        discarded(filters)
        return out
    bounds = np.array([segments * k // slices for k in range(1, slices)])
    table = written(raw_text(docs).mapInArrow(tidied(_sliced(min_chars, segments, bounds)), HASHED), "line-digests", by="slice")
    found = []
    for k, (a, b) in enumerate(zip([0, *bounds.tolist()], [*bounds.tolist(), segments], strict=True)):
        shared = _held(spark, filters.where(f"segment >= {a} and segment < {b}"), segments)
        found.append(written(table.where(f"slice = {k}").select("digest", "doc_id").mapInArrow(tidied(_tested(_read_digests, segments, shared)), SUSPECT), "line-suspects"))
        shared.unpersist()
    out = written(reduce(DataFrame.union, found), "line-suspects")
    discarded(table, filters, *found)
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digest) of the lines to drop: keys found in ``min_docs`` documents, outside the largest doc_id with the key."""
    lines = suspects(docs, min_chars)
    confirmed = lines.groupBy("digest", "doc_id").agg(F.count("*").alias("k")).groupBy("digest").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.max("doc_id").alias("stays"))
    confirmed = written(confirmed.where(F.col("n") >= min_docs), "line-counts")
    total = confirmed.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    return matched(lines, confirmed, "digest", "k", total).where("doc_id != stays").select("doc_id", "digest")


OUT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _kept(least: int, names: list[str], extra: str, out_name: str):
    def run(batches):
        for batch in pieces(batches, 8 << 20):
            raw = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            totals, dropped = [], []
            for k, drop in enumerate(column(batch, extra)):
                lines = (raw[k] or b"").split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x, d in zip(lines, digests(raw[k], least), strict=True) if d not in drop]
                    raw[k] = b"\n".join(kept)
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            out = pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=["n_lines", "n_dropped"])
            text = pa.array(raw, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(text if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names), out], names=[*names, out_name])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text that is left (a null text stays null) and one more last column, a struct of n_lines and n_dropped; its name
    is ``__wl_out``, with underscores behind if ``docs`` has that."""
    key, extra, out = free_name(docs, "id"), free_name(docs, "drop"), free_name(docs, "out")
    drops = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs).groupBy("doc_id").agg(F.collect_set("digest").alias(extra)).withColumnRenamed("doc_id", key)
    drops = written(drops, "line-drops")
    rows, lines = drops.agg(F.count("*"), F.coalesce(F.sum(F.size(extra)), F.lit(0))).first()
    joined = attached(docs, drops, key, 64 * rows + 32 * lines)
    return joined.mapInArrow(tidied(_kept(min_chars, docs.columns, extra, out)), extended(docs, [T.StructField(out, OUT)]))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with the text that is left. A null text stays null, n_chars follows the text."""
    return with_length(dedup_lines(docs)).select(*docs.columns)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
