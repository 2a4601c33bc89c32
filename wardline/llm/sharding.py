"""Two-pass external shuffle into shards.

Pass 1 scatters whole records into buckets by a seeded hash of doc_id, the text and, of rows that are equal in both, of their number
by COPIES; there are so many buckets, by the measured bytes of all texts, that one fits in memory. Pass 2 sorts a bucket, so that
the result doesn't depend on the order of arrival, shuffles it by Fisher-Yates with a generator seeded by (seed, bucket) and
writes it. Buckets one after another make a uniform permutation of all records; a record's place in it, counted from the sizes of
the buckets before, is dealt round to the shards: shard = place mod shards, slot = place div shards. So shard counts differ by one
at most and slots have no gaps: the law `rows`. The same rows get the same places however they are laid out in files.

Cases: null texts have no bytes. Rows that share a doc_id, or have none, part by their texts; of equal rows COPIES at most share a
bucket, and they are interchangeable. A text longer than a bucket makes its bucket so much larger. An empty table gives an empty
table. Other columns travel along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, PRIVATE, extended, free_name, written

SHARDS, SEED, BUCKET_BYTES, ROW_BYTES = 40, 20240229, 16 << 20, 16
#: Equal rows that share a bucket; buckets whose sizes are summed together, so that no task sums the sizes of all.
COPIES, CHUNK = 1000, 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places (``Generator.permutation`` is a Fisher-Yates shuffle)."""
    return np.random.Generator(np.random.PCG64([seed & (2**63 - 1), bucket])).permutation(n)


def _shuffled(names: list[str], order: list[str], bucket: str, first: str, shards: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        number, begin = (table.column(c)[0].as_py() for c in (bucket, first))
        table = table.sort_by([(c, "ascending") for c in order])
        place = np.empty(len(table), dtype=np.int64)
        place[fisher_yates(len(table), seed, number)] = np.arange(len(table))
        place += begin
        return table.select(names).append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    return run


def _text_hash() -> F.Column:
    return F.xxhash64(F.lit(1), F.col("text"))


def _bucket(doc: str, digest: str, copy: str, seed: int, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(doc), F.col(digest), F.col(copy), F.lit(seed)), F.lit(buckets)).cast("long")


def _numbered(docs: DataFrame, hot: DataFrame, digest: str, copy: str, copies: int) -> DataFrame:
    """``docs`` with its equal rows beyond ``copies`` numbered: ``copy`` is that number by ``copies``, 0 elsewhere. ``hot`` are the few
    (doc_id, digest, k) of such rows. They are written with a salt, numbered in each salt, and from the sizes of the salts before."""
    names = {c: free_name(docs, c) for c in ("doc", "hash", "k", "salt", "row")}
    few = F.broadcast(hot.select(F.col("doc_id").alias(names["doc"]), F.col("digest").alias(names["hash"]), F.col("k").alias(names["k"])))
    meets = docs["doc_id"].eqNullSafe(F.col(names["doc"])) & (docs[digest] == F.col(names["hash"]))
    salts = F.expr(f"1 + `{names['k']}` div {copies}")
    many = written(docs.join(few, meets).withColumn(names["salt"], F.pmod(F.monotonically_increasing_id(), salts)).drop(names["doc"], names["hash"], names["k"]), "copies")
    key = ["doc_id", digest]
    sizes = many.groupBy(*key, names["salt"]).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy(names["salt"]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("doc_id").alias("_d"), F.col(digest).alias("_h"), F.col(names["salt"]).alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy(*key, names["salt"]).orderBy(F.lit(0))) - 1
    own = many.withColumn(names["row"], place)
    own = own.join(sizes, own["doc_id"].eqNullSafe(F.col("_d")) & (own[digest] == F.col("_h")) & (own[names["salt"]] == F.col("_s")))
    own = own.withColumn(copy, F.floor((F.col(names["row"]) + F.col("_b")) / copies).cast("long")).drop("_d", "_h", "_s", "_b", names["row"], names["salt"])
    return docs.join(few, meets, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(own)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """``docs`` with ``__wl_shard`` and ``__wl_slot`` (with underscores behind if ``docs`` has them), read back from the written buckets."""
    kinds = written(docs.groupBy("doc_id", _text_hash().alias("digest")).agg(F.count("*").alias("k"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")), "shard-keys")
    rows, size, most = kinds.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * (F.col("b") + ROW_BYTES)), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    buckets, copies = max(1, -(-size // bucket_bytes)), max(copies, rows // HOT_KEYS)
    digest, copy, bucket, first = (free_name(docs, c) for c in ("digest", "copy", "bucket", "first"))
    # The sizes of all buckets are known from the kinds of rows.
    split = kinds.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {copies}"))))
    split = split.withColumn("k", F.least(F.lit(copies), F.col("k") - F.col("copy") * copies))
    sizes = split.groupBy(_bucket("doc_id", "digest", "copy", seed, buckets).alias("bucket")).agg(F.sum("k").alias("k")).withColumn("chunk", F.floor(F.col("bucket") / CHUNK))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.groupBy("chunk").agg(F.sum("k").alias("k")).select("chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "chunk", F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("before")).join(chunks, "chunk")
    starts = starts.select(F.col("bucket").alias(bucket), (F.col("before") + F.col("base")).cast("long").alias(first))
    marked = docs.withColumn(digest, _text_hash())
    if most > copies:
        marked = _numbered(marked, kinds.where(F.col("k") > copies), digest, copy, copies)
    else:
        marked = marked.withColumn(copy, F.lit(0).cast("long"))
    marked = marked.withColumn(bucket, _bucket("doc_id", digest, copy, seed, buckets)).join(starts, bucket)
    schema = extended(docs, [T.StructField(free_name(docs, "shard"), T.IntegerType()), T.StructField(free_name(docs, "slot"), T.LongType())])
    return written(marked.groupBy(bucket).applyInArrow(_renamed(_shuffled(docs.columns, [copy, "doc_id", digest], bucket, first, shards, seed), schema.names), schema), "buckets")


def _renamed(run, names: list[str]):
    return lambda table: run(table).rename_columns(names)


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The shards as Parquet folders ``__wl_shard=N``, each in slot order."""
    done = shard(docs, shards, seed)
    done.repartition(shards, PRIVATE + "shard").sortWithinPartitions(PRIVATE + "shard", PRIVATE + "slot").write.partitionBy(PRIVATE + "shard").parquet(path)
