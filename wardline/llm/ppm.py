"""Language-model scoring by prediction by partial matching (PPM, escape method C).

The model is a trie of byte contexts of up to ORDER bytes with the counts of the symbols that follow: a byte, or the end
of a text. A symbol is predicted in the longest context that is known; if it was never seen there, an escape leads to the next
shorter context, where the symbols of the longer one are excluded; below order 0 the remaining symbols are equally likely. With
counts of whole texts the symbols of a context are among those of its suffix, so what exclusion takes from a shorter context
depends on the longer one alone and is stored there. That makes scoring a few table look-ups a byte, done for all bytes at once.

The trie is never limited: it grows with the training texts and lies spread over the tasks. Texts are kept in parts of about PART
bytes. Each part's distinct codes (a context and its symbol) are counted once; sums over the parts are the trie's highest order,
and sums over longer contexts its lower ones. It is grouped by the two last bytes of the context: all that a code meets on its way
down to order 2 ends in the same two bytes. Orders 0 and 1, at most 257 * 257 codes for any corpus, are given to each group.
A group scores each of its codes once, learnt or not; each part then meets the scores of its own codes by a join and sums them along
its texts. A task holds a group's codes, or a text part and its codes; the driver gets orders 0 and 1 alone.

Beside it a unigram base model over words is computed. Its counts are never limited: the most frequent words, at most HOT of them by
a histogram of the counts, are broadcast with their counts, those of more than HOT_BYTES as digests; the others, each rarer than these,
meet their counts by a join.

Cases: a null or empty text is its end alone. Texts of any length are scored whole. Rows that repeat a doc_id are each
returned, and learnt from, once. A null doc_id is no held-out row. Without training texts all symbols are equally likely and
base_score is computed with N = V = 0. Extra columns are left behind.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, column, pieces, raw_text, released, tidied, written

ORDER = 4
#: About the bytes of a part's texts, and the codes of a group of the trie.
PART, GROUP = 16 << 20, 200_000
SYMBOLS, END = 257, 256
HOT, HOT_BYTES = 200_000, 64
FOLDS, HELD = 5, 1
PARTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("row", T.LongType()),
        T.StructField("text", T.BinaryType()),
        T.StructField("part", T.LongType()),
    ]
)
SEEN = T.StructType([T.StructField("part", T.LongType()), T.StructField("code", T.LongType()), T.StructField("count", T.LongType())])
VALUED = T.StructType([T.StructField("code", T.LongType()), T.StructField("value", T.DoubleType())])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, its end included: context << 9 | symbol; and the first place of each text. A text is preceded by zeros."""
    sizes = np.array([len(t) + order + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(b"\0" * order + t + b"\0" for t in texts), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    context = np.zeros(len(data), dtype=np.uint64)
    for j in range(1, order + 1):
        context[j:] |= data[:-j] << np.uint64(8 * (j - 1))
    symbol = data
    symbol[ends - 1] = END
    found = context << np.uint64(9) | symbol
    keep = np.ones(len(data), dtype=bool)
    for j in range(order):
        keep[ends - sizes + j] = False
    return found[keep].view(np.int64), ends - sizes - order * np.arange(len(texts))


def _parted(batches):
    part, size = TaskContext.get().partitionId() << 32, 0
    for batch in pieces(batches, 2 << 20):
        if batch.num_rows:
            own = batch.column(3).nbytes
            if size and size + own > PART:
                part, size = part + 1, 0
            size += own
            yield batch_of(PARTED, [*batch.columns, np.full(batch.num_rows, part)])


def parted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, numbered, with the part each belongs to."""
    own = raw_text(docs.withColumn("held_out", held_out()).withColumn("row", F.monotonically_increasing_id()), "held_out", "row")
    return written(own.mapInArrow(tidied(_parted), PARTED), "parts")


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(code, return_inverse=True)
    return own, np.bincount(at, weights=count, minlength=len(own)).astype(np.int64)


def _counted(order: int):
    """Each part's distinct codes and how often they are learnt there, which may be never. A part may come in several pieces."""

    def run(batches):
        now, parts, size = None, [], 0

        def flush():
            code, count = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts[:] = [(code, count)]
            return len(code)

        def out():
            flush()
            return batch_of(SEEN, [np.full(len(parts[0][0]), now), *parts[0]])

        for batch in pieces(batches, 2 << 20):
            part, held = batch.column(4).to_numpy(), np.array(column(batch, "held_out"), dtype=bool)
            texts = [x or b"" for x in column(batch, "text")]
            for own in np.unique(part):
                if parts and (own != now or size > 1_500_000):
                    yield out()
                    parts, size = [], 0
                now = own
                for learnt in (True, False):
                    mine = [texts[j] for j in np.flatnonzero((part == own) & (held != learnt))]
                    if mine:
                        code, count = np.unique(codes(mine, order)[0], return_counts=True)
                        parts.append((code, count * learnt))
                        size += len(code)
                if size > 3_000_000:
                    size = flush()
        if parts:
            yield out()

    return run


class Lookup:
    """Values of distinct codes by a hash table: where each slot's codes begin."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        slot = self._slot(codes)
        order = np.argsort(slot, kind="stable")
        self.keys, self.value = codes[order], values[order]
        self.begin = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begin).max()) if len(self.keys) else 0

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, code: np.ndarray) -> np.ndarray:
        """Each code's value, NaN for one that isn't known."""
        out = np.full(len(code), np.nan)
        if len(self.keys):
            at = self.begin[slot := self._slot(code)]
            end = self.begin[1:][slot]
            here = np.minimum(at, len(self.keys) - 1)
            ok = (at < end) & (self.keys[here] == code)
            out[ok] = self.value[here[ok]]
            open_ = np.flatnonzero(~ok & (end - at > 1))
            for j in range(1, self.most):
                rows = open_[at[open_] + j < end[open_]]
                ok = self.keys[at[rows] + j] == code[rows]
                out[rows[ok]] = self.value[at[rows[ok]] + j]
                open_ = rows
        return out


def _along(texts: list[bytes], order: int, scores) -> np.ndarray:
    """The sum of ``scores`` of its codes for each text."""
    code, starts = codes(texts, order)
    each = np.concatenate([scores(code[a : a + (1 << 18)]) for a in range(0, len(code), 1 << 18)])
    return np.add.reduceat(each, starts)


class Model:
    """The trie as arrays: for each order the sorted codes with their counts, and what its contexts add up to."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts``: (codes, counts) by order, from 0 on, sorted by code."""
        self.order = len(counts) - 1
        self.codes = [c for c, _ in counts]
        self.log = [np.log10(np.maximum(n, 1)) for _, n in counts]
        self.contexts, totals, kinds, first = [], [], [], []
        for code, n in counts:
            own, at = np.unique(code >> 9, return_index=True)
            self.contexts.append(own)
            first.append(at)
            totals.append(np.add.reduceat(n, at).astype(np.float64) if len(at) else np.zeros(0))
            kinds.append(np.diff(np.append(at, len(code))).astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            #: A known context met first: the logarithms of its denominator and of its escape.
            self.whole = [np.log10(t + d) for t, d in zip(totals, kinds, strict=True)]
            self.leave = [np.log10(d) - w for d, w in zip(kinds, self.whole, strict=True)]
            #: The shorter context after an escape from this one: its denominator under exclusion, and the escapes from there on down.
            self.under, self.sum, self.suffix = [], [], []
            for k, (code, _) in enumerate(counts):
                if k == 0:
                    left = np.maximum(SYMBOLS - kinds[0], 0)
                    self.under.append(np.log10(np.maximum(left, 1)))
                    self.sum.append(np.zeros(len(left)))
                    self.suffix.append(np.zeros(len(left), dtype=np.int64))
                    continue
                mask = (1 << 8 * (k - 1)) - 1
                shorter = np.searchsorted(self.contexts[k - 1], self.contexts[k] & mask)
                at = np.searchsorted(counts[k - 1][0], (code >> 9 & mask) << 9 | code & 511)
                gone = np.add.reduceat(counts[k - 1][1][at], first[k]) if len(first[k]) else np.zeros(0)
                fresh = kinds[k - 1][shorter] - kinds[k]
                den = totals[k - 1][shorter] - gone + fresh
                self.under.append(np.log10(np.maximum(den, 1)))
                step = np.where(fresh > 0, np.log10(np.maximum(fresh, 1)) - self.under[-1], 0.0)
                self.sum.append(step + self.sum[k - 1][shorter])
                self.suffix.append(shorter)
        where = np.searchsorted(self.contexts[-1], self.codes[-1] >> 9)
        self.highest = Lookup(self.codes[-1], self.log[-1] - self.whole[-1][where])

    def scores(self, code: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability."""
        out = self.highest.found(code)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            own, at = np.unique(code[rest], return_inverse=True)
            out[rest] = self._escaped(own)[at]
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), -np.log10(SYMBOLS))
        if not len(self.contexts[0]):
            return out
        context, symbol = code >> 9, code & 511
        spent = np.zeros(len(code))  # logarithms of the escapes until here
        above = np.full(len(code), -1)  # the context that was left, of one order more
        done = np.zeros(len(code), dtype=bool)
        for k in range(self.order, -1, -1):
            own = context & (1 << 8 * k) - 1
            here = np.minimum(np.searchsorted(self.contexts[k], own), len(self.contexts[k]) - 1) if len(self.contexts[k]) else np.zeros(len(code), dtype=np.int64)
            known = (self.contexts[k][here] == own if len(self.contexts[k]) else np.zeros(len(code), dtype=bool)) & ~done
            place = np.minimum(np.searchsorted(self.codes[k], own << 9 | symbol), max(len(self.codes[k]) - 1, 0))
            seen = known & (self.codes[k][place] == (own << 9 | symbol) if len(self.codes[k]) else False)
            started = above >= 0
            den = np.where(started, self.under[k + 1][above] if k < self.order and len(self.under[k + 1]) else 0.0, self.whole[k][here] if len(self.whole[k]) else 0.0)
            out[seen] = (spent + self.log[k][place] - den)[seen] if len(self.log[k]) else out[seen]
            done |= seen
            go = known & ~seen
            first = go & ~started
            spent[first] += self.leave[k][here[first]] if len(self.leave[k]) else 0.0
            later = go & started
            if later.any():
                v = above[later]
                spent[later] += self.sum[k + 1][v] - self.sum[k][self.suffix[k + 1][v]]
            above[go] = here[go]
            above[~go] = -1
        rest = ~done
        out[rest] = spent[rest] - self.under[0][0]
        return out

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        return _along(texts, self.order, self.scores)


def _levels(code: np.ndarray, count: np.ndarray, order: int, least: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of orders ``least`` to ``order``, sorted by code, from those of ``order``."""
    out = [_summed(code, count)] if order >= least else []
    for k in range(order - 1, least - 1, -1):
        code, count = out[-1]
        out.append(_summed((code >> 9 & (1 << 8 * k) - 1) << 9 | code & 511, count))
    return out[::-1]


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("code").to_numpy(), table.column("count").to_numpy()


def train(docs: DataFrame, order: int = ORDER, nodes: int | None = None) -> Model:
    """The model of all texts of ``docs`` in one piece, for corpora whose trie fits the driver; ``score`` doesn't use it. With ``nodes``,
    codes below the least frequency that leaves at most so many in each order are left out."""
    learnt = parted(docs).withColumn("held_out", F.lit(False))
    seen = learnt.mapInArrow(tidied(_counted(order)), SEEN).groupBy("code").agg(F.sum("count").alias("count"))
    levels = _levels(*_arrays(seen.toArrow()), order)
    if nodes is not None:
        least = max([1, *(int(np.sort(n)[-1 - nodes]) + 1 for _, n in levels if len(n) > nodes)])
        levels = [(code[n >= least], n[n >= least]) for code, n in levels]
    return Model(levels)


def _valued(base: list[tuple[np.ndarray, np.ndarray]], order: int):
    def run(group: pa.Table) -> pa.Table:
        code, count = _arrays(group)
        learnt = count > 0
        model = Model([*base, *_levels(code[learnt], count[learnt], order, len(base))])
        return pa.Table.from_batches([batch_of(VALUED, [code, model.scores(code)])])

    return run


def valued(seen: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 of the probability of each code in ``seen``, in the model of all that was learnt there."""
    counts = written(seen.groupBy("code").agg(F.sum("count").alias("count")), "counts")
    low = min(order, 1)
    shorter = F.shiftright("code", 9).bitwiseAND((1 << 8 * low) - 1) * 512 + F.col("code").bitwiseAND(511)
    base = _levels(*_arrays(counts.where("count > 0").groupBy(shorter.alias("code")).agg(F.sum("count").alias("count")).toArrow()), low)
    groups = 1 + counts.count() // GROUP
    last = F.shiftright("code", 9).bitwiseAND(0xFFFF)
    return counts.groupBy(F.pmod(F.hash(last), F.lit(groups)).alias("group")).applyInArrow(_valued(base, order), VALUED)


WORD = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("count", T.LongType())])


def _vocabulary(batches):
    total: Counter = Counter()
    for batch in pieces(batches):
        for text in column(batch, "text"):
            total.update((text or b"").lower().split())
        if len(total) > 300_000:
            yield batch_of(WORD, [list(total), list(total.values())])
            total = Counter()
    yield batch_of(WORD, [list(total), list(total.values())])


def word_key(word: bytes) -> bytes:
    """What the broadcast words are known by: a long word by a blank, which is in no word, and its 128-bit digest."""
    return word if len(word) <= HOT_BYTES else b" " + xxhash.xxh3_128_digest(word)


def _keyed(batches):
    for batch in batches:
        yield batch_of(WORD, [[word_key(w) for w in column(batch, "word")], batch.column(batch.schema.get_field_index("count"))])


def frequent_words(vocabulary: DataFrame, hot: int) -> list[tuple[bytes, int]]:
    """(key, count) of the words with a count that at most ``hot`` words reach, as far as a histogram of counts in steps of 1/8 of a power of two tells."""
    step = F.floor(F.log2("count") * 8).cast("long").alias("step")
    cut, sizes = None, vocabulary.select(step).groupBy("step").count().collect()
    for r in sorted(sizes, key=lambda r: -r.step):
        hot -= r["count"]
        if hot < 0:
            break
        cut = r.step
    if cut is None:
        return []
    table = vocabulary.where(F.floor(F.log2("count") * 8) >= cut).mapInArrow(_keyed, WORD).toArrow()
    return list(zip(table.column("word").to_pylist(), table.column("count").to_pylist(), strict=True))


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("row", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_hot", T.LongType()),
        T.StructField("hot", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
    ]
)


def _scored(shared, order: int):
    def run(part: pa.Table, values: pa.Table) -> pa.Table:
        hot, end = shared.value
        get = hot.get
        code, at = np.unique(values.column("code").to_numpy(), return_index=True)
        found = Lookup(code, values.column("value").to_numpy()[at]).found
        out = []
        for batch in pieces(part.to_batches(), 2 << 20):
            texts = [x or b"" for x in column(batch, "text")]
            n, known, total, words, counts = [], [], [], [], []
            for text in texts:
                split = text.lower().split()
                own, w, c, k, s = Counter(split), [], [], int(end is not None), end or 0.0
                for word, times in own.items():
                    if (v := get(word if len(word) <= HOT_BYTES else word_key(word))) is None:
                        w.append(word)
                        c.append(times)
                    else:
                        k += times
                        s += times * v
                n.append(len(split) + 1)
                known.append(k)
                total.append(s)
                words.append(w)
                counts.append(c)
            if texts:
                out.append(batch_of(SCORED, [batch.column(0), batch.column(1), batch.column(2), n, known, total, _along(texts, order, found), words, counts]))
        whole = pa.Table.from_batches(out)
        released()
        return whole

    return run


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; learnt from rows that aren't held out."""
    spark = docs.sparkSession
    parts = parted(docs.select("doc_id", "text"))
    learnt = parts.where(~F.col("held_out"))
    seen = written(parts.mapInArrow(tidied(_counted(order)), SEEN), "seen")
    vocabulary = written(raw_text(learnt).mapInArrow(tidied(_vocabulary), WORD).groupBy("word").agg(F.sum("count").alias("count")), "vocabulary")
    texts = learnt.count()
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + texts, kinds + bool(texts)
    known = {w: float(np.log10(c + 0.5)) for w, c in frequent_words(vocabulary, hot)}
    shared = spark.sparkContext.broadcast((known, float(np.log10(texts + 0.5)) if texts else None))
    n = max(1, parts.select("part").distinct().count())
    values = seen.select("part", "code").join(valued(seen, order), "code").repartition(n, "part").groupBy("part")
    scored = written(parts.repartition(n, "part").groupBy("part").cogroup(values).applyInArrow(_scored(shared, order), SCORED), "scored")
    cold = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("times"))
    met = cold.join(vocabulary, "word").groupBy("row").agg(F.sum("times").alias("n_cold"), F.sum(F.col("times") * F.log10(F.col("count") + 0.5)).alias("cold"))
    out = scored.drop("words", "counts").join(met, "row", "left").na.fill(0, ["n_cold"]).na.fill(0.0, ["cold"])
    n_known = F.col("n_hot") + F.col("n_cold")
    base = F.col("hot") + F.col("cold") + (F.col("n_tokens") - n_known) * F.lit(float(np.log10(0.5))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (kinds + 1))))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
