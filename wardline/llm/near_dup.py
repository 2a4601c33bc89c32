"""Near-duplicate documents by SetSketch registers.

A register holds floor(1 - log_b x) of the smallest exponential value x that any shingle takes in it: truncated,
exponentially spaced minima that merge by maximum and agree in a register about as often as the sets' Jaccard similarity.
BANDS bands of ROWS registers give candidates; pairs at 0.8 meet in a band but for a chance of (1 - 0.8**4)**32 = 5e-8.
A candidate's similarity is estimated by likelihood from the registers that are larger on one side, larger on the other,
and equal, with both set sizes known; it goes on unless the threshold is less likely than the estimate by e**MARGIN. The
rest is verified on the full sets of 64-bit shingle hashes.

No bucket's pairs are all emitted. Copies of one set form a class with one representative. PIVOT_ROUNDS rounds pair each
member of a bucket with a pivot of the bucket, the member that meets most others in all its buckets: of texts made from one
original, which may be far from one another, that is the original. Verified links join components, and a bucket of one
component is done.
What is left for the last round are the members of buckets of several components. Texts around one passage are many and alike
but below the threshold, so their pairs are not all taken: a pair at the threshold has a shingle in common among the rarest
fifth (and one) of either set, and just the pairs that have are taken. None at the threshold is lost by that. A shingle of at
most FEW members joins them; one of more deals them into blocks of about BLOCK, and each pair of blocks is a group of its own that
gives out only the pairs that sizes, positions and registers allow. Components are found by large-star/small-star contraction on
tables in the shared folder; nothing of the documents reaches the driver but counts. What is joined with a table that has one row
a bucket, shingle or node meets it as a written table: a small one is broadcast by its size, beside a larger one AQE splits a hot
key's partition.

Cases: a null, empty or blank text has no set, forms its own component and stays. Fewer words than a shingle's make one
shingle. Rows that repeat a doc_id are one document in links; each row is returned. Null doc_ids link with nothing. Extra
columns are left behind by ``components`` and kept by ``stage``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PRIVATE, batch_of, column, discarded, pieces, raw_text, small_batches, tidied, within, written

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
MARGIN = 16.0
PIVOT_ROUNDS = 2
#: Members of a shingle up to which they are joined, and about how many a block of a larger group has.
FEW, BLOCK = 64, 1024
_rng = np.random.Generator(np.random.PCG64(20240229))
MULTIPLY = _rng.integers(1 << 62, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
COMBINE = _rng.integers(1 << 62, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
BAND = _rng.integers(1 << 62, 1 << 64, BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    if len(h) < words:
        return mixed(np.array([np.uint64(xxhash.xxh3_64_intdigest(b" ".join(found)))], dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - words + 1
    total = h[:n] * COMBINE[0]
    for j in range(1, words):
        total += h[j : n + j] * COMBINE[j]
    return np.unique(mixed(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * MULTIPLY[None, :]).min(axis=0), out=least)
    return values(least)


def values(least: np.ndarray) -> np.ndarray:
    """Registers of the smallest uniform value, as a 64-bit fraction, that each takes."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(own: np.ndarray) -> np.ndarray:
    return mixed(own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + BAND).view(np.int64)


def _chance(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(j, more, less, same, na, nb):
    """Log likelihood of similarity ``j`` given how many registers are larger in a, larger in b, and equal."""
    u, v = na / (na + nb), nb / (na + nb)
    a, b = np.maximum(_chance(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_chance(np.maximum(v - u * j, 0)), 1e-12)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of register rows may reach the threshold: not if it is less likely than the estimate by e**MARGIN."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    most, least = np.minimum(na, nb) / np.maximum(na, nb), percent / 100
    low, high = np.zeros(len(a)), most.copy()
    for _ in range(30):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(one, more, less, same, na, nb) < likelihood(two, more, less, same, na, nb)
        low, high = np.where(up, one, low), np.where(up, high, two)
    best = (low + high) / 2
    gap = likelihood(best, more, less, same, na, nb) - likelihood(np.minimum(least, most), more, less, same, na, nb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((best >= least) | (gap <= MARGIN))


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("registers", T.BinaryType())])


def _sketch(words: int):
    def run(batches):
        for batch in pieces(batches):
            n, digest, own = [], [], []
            for text in column(batch, "text"):
                h = shingles(text, words)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                own.append(registers(h).tobytes() if len(h) else None)
            yield batch_of(SKETCH, [batch.column(0), n, digest, own])

    return run


SET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hashes", T.BinaryType())])


def _sets(words: int):
    def run(batches):
        for batch in pieces(batches):
            yield batch_of(SET, [batch.column(0), [shingles(x, words).tobytes() for x in column(batch, "text")]])

    return run


BANDED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType())])


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = np.concatenate([band_keys(np.frombuffer(x, dtype=np.uint16)) for x in column(batch, "registers")])
            rep, n = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(), BANDS) for c in ("rep", "n"))
            yield batch_of(BANDED, [keys, rep, n])


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _rows(batch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name)), dtype=np.uint16).reshape(-1, REGISTERS)


def _likely(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
                keep = np.flatnonzero(possible(_rows(batch, "ra"), _rows(batch, "rb"), na, nb, percent))
                yield batch_of(PAIR, [batch.column(batch.schema.get_field_index(c)).take(keep_array(keep)) for c in ("a", "b")])

    return run


def keep_array(rows: np.ndarray):
    import pyarrow as pa

    return pa.array(rows)


def linked(x: bytes, y: bytes, percent: int) -> bool:
    both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
    return 100 * both >= percent * (len(x) // 8 + len(y) // 8 - both)


def _links(percent: int):
    def run(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(column(batch, "ha"), column(batch, "hb"), strict=True)) if linked(x, y, percent)]
            yield batch_of(PAIR, [batch.column(batch.schema.get_field_index(c)).take(keep_array(np.array(keep, dtype=np.int64))) for c in ("a", "b")])

    return run


SHINGLE = T.StructType([T.StructField("rep", T.LongType()), T.StructField("shingle", T.LongType())])


def _exploded(words: int):
    def run(batches):
        for batch in pieces(batches, 1 << 20):
            found = [(doc, shingles(x, words)) for doc, x in zip(column(batch, "doc_id"), column(batch, "text"), strict=True)]
            if found:
                yield batch_of(SHINGLE, [np.repeat([d for d, _ in found], [len(h) for _, h in found]), np.concatenate([h for _, h in found]).view(np.int64)])

    return run


def block_pairs(x: dict, y: dict | None, percent: int):
    """(a, b) of the rows of ``x`` and ``y``, or of ``x`` alone, that may reach the threshold by components, sizes, places of their common
    shingle and registers. x and y: arrays rep, n, component, rank and registers."""
    z = x if y is None else y
    for k in range(len(x["rep"])):
        n, m = x["n"][k], z["n"]
        fit = (z["component"] != x["component"][k]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        fit &= (100 + percent) * (1 + np.minimum(n - x["rank"][k], m - z["rank"])) >= percent * (n + m)
        if y is None:
            fit[: k + 1] = False
        at = np.flatnonzero(fit)
        if len(at):
            own = np.broadcast_to(x["registers"][k], (len(at), REGISTERS))
            at = at[possible(own, z["registers"][at], np.full(len(at), n), m[at], percent)]
            yield np.full(len(at), x["rep"][k]), z["rep"][at]


def _blocks(percent: int):
    def run(table):
        import pyarrow as pa

        own = {c: table.column(c).to_numpy() for c in ("rep", "n", "component", "rank", "block")}
        own["registers"] = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = ({c: v[own["block"] == block] for c, v in own.items()} for block in (i, j))
        found = list(block_pairs(x, None if i == j else y, percent))
        a, b = (np.concatenate([p[side] for p in found]) if found else np.empty(0, dtype=np.int64) for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def contracted(links: DataFrame) -> DataFrame:
    """(rep, component): the smallest id of each node's component, by large-star/small-star contraction."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, written(small, "edges")
        discarded(old, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("rep"), F.col("b").alias("component"))
        before = now


class _Search:
    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int):
        self.docs, self.reps, self.words, self.percent = docs, reps, words, percent

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the registers allow and the full sets confirm."""
        own = self.reps
        a = own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        b = own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        likely = written(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(self.percent), PAIR), "likely")
        ids = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()
        sets = written(within(raw_text(self.docs), ids).mapInArrow(tidied(_sets(self.words)), SET), "sets")
        x, y = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
        return written(likely.join(x, "a").join(y, "b").select("a", "b", "ha", "hb").mapInArrow(tidied(_links(self.percent)), PAIR), "links")


    def rare_meetings(self, members: DataFrame) -> DataFrame:
        """Pairs of ``members`` (rep, n, component) of different components with a common shingle in both prefixes: the rarest of each set, as many
        as a partner at the threshold can't all miss."""
        members = members.distinct()
        ids = members.select(F.col("rep").alias("doc_id")).distinct()
        found = written(within(raw_text(self.docs), ids).mapInArrow(tidied(_exploded(self.words)), SHINGLE).distinct(), "shingles")
        counts = written(found.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "counts")
        common = found.join(counts, "shingle").join(members, "rep")
        by = Window.partitionBy("rep")
        rank = F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("df", "shingle"))
        prefix = F.col("n") - F.expr(f"(n * {self.percent} + 99) div 100") + 1
        kept = common.withColumn("rank", rank).where(F.col("rank") <= prefix).select("shingle", "rep", "n", "component", "rank")
        several = kept.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high").select("shingle", "size")
        kept = written(kept.join(written(several, "several"), "shingle"), "prefixes")
        few, many = kept.where(F.col("size") <= FEW), kept.where(F.col("size") > FEW)
        other = few.select("shingle", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("rank").alias("rank2"))
        # What a pair has in common is not before its first common shingle in either set.
        enough = f"{100 + self.percent} * (1 + least(n - rank, m - rank2)) >= {self.percent} * (n + m)"
        pairs = few.join(other, "shingle").where(enough).where(f"rep > b and component != c and 100 * least(n, m) >= {self.percent} * greatest(n, m)")
        small_batches(self.docs.sparkSession)
        blocks = F.ceil(F.col("size") / BLOCK)
        dealt = many.join(self.reps.select("rep", "registers"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        dealt = dealt.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "component", "rank", "registers")
        met = dealt.groupBy("shingle", "i", "j").applyInArrow(_blocks(self.percent), PAIR)
        return pairs.select(F.col("rep").alias("a"), "b").union(met)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    docs = docs.select("doc_id", "text")
    sketches = written(raw_text(docs).mapInArrow(tidied(_sketch(words)), SKETCH), "sketches")
    sets = sketches.where("doc_id is not null and n > 0")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    reps = written(classes, "classes")
    banded = reps.select("rep", "n", "registers").mapInArrow(_bands, BANDED)
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).where("low != high").select("bucket", "size")
    members = written(banded.join(written(shared, "shared"), "bucket"), "members")
    central = members.groupBy("rep").agg(F.sum("size").alias("met"))
    members = written(members.drop("size").join(central, "rep"), "members")
    pivot = F.max_by("rep", F.struct("met", -F.col("rep"))).alias("pivot")
    search = _Search(docs, reps, words, percent)
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    # Round one: each member and the pivot that it shares most buckets with.
    met = members.join(written(members.groupBy("bucket").agg(pivot), "pivots"), "bucket").where("rep != pivot").groupBy("rep", "pivot").agg(F.count("*").alias("k")).groupBy("rep").agg(F.max_by("pivot", F.struct("k", -F.col("pivot"))).alias("pivot"))
    tried = written(met.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "tried")
    links = search.verified(tried)
    labels = written(contracted(links), "labels")
    for turn in range(1, PIVOT_ROUNDS + 1):
        here = members.select("bucket", "rep", "n", "met").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_up = here.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot).where("low != high").select("bucket", "pivot")
        open_ = written(here.join(written(mixed_up, "mixed"), "bucket"), "open")
        if turn < PIVOT_ROUNDS:
            other = open_.where("rep = pivot").select("bucket", F.col("n").alias("m"), F.col("component").alias("c"))
            pairs = open_.join(other, "bucket").where(fits).where("component != c").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        else:
            pairs = search.rare_meetings(open_.select("rep", "n", "component"))
        new = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = written(new.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "tried")
        links = links.union(search.verified(new))
        tried = tried.union(new)
        labels = written(contracted(links), "labels")
    named = reps.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component, that with the smallest doc_id. Every row with a null doc_id stays."""
    gone = components(docs).where(~F.col("kept")).select(F.col("doc_id").alias(PRIVATE + "id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone[PRIVATE + "id"], "left_anti").select(*docs.columns)
