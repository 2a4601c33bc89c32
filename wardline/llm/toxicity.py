"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: compatibility forms, letters that look like Latin ones, digits and signs that stand for letters,
invisible characters and case. Patterns are whole words and beginnings of words. Their weights are log odds, learnt from a bounded
sample of labelled rows (FIT_ROWS of each label, smallest hashes first); a pattern must be in SUPPORT toxic texts, and in the share
SHARE of them, and have weight LEAST. All such patterns are taken; that are at most 1 / SHARE times as many as a toxic text has on
average. A match inside an exception phrase doesn't count. The features of a text are the sum of its matches' weights and that sum
by the logarithm of its length in words; a logistic function fitted to the sample turns them into a score.

Cases: a null or empty text has no matches and gets the score of a text without any. Without labels of both kinds the
lexicon is empty and all scores are 0. Rows of labels that repeat a doc_id count once, as toxic if any says so; null
labels and ids don't count. Rows that repeat a doc_id are each returned. Long texts are matched whole.
Extra columns are left behind by ``scores`` and kept by ``stage``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PRIVATE, batch_of, column, extended, pieces, tidied, written

FIT_ROWS, SUPPORT, SHARE, LEAST = 4000, 4, 0.01, 2.5
FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Lengths of the beginnings of words that may become patterns.
BEGINNINGS = (4, 5, 6, 7)

# What stands for a Latin letter.
LOOK_ALIKES = {
    "a": "а α á à â ä ã å ā @ 4",
    "b": "в β ь 8",
    "c": "с ç ć ¢",
    "d": "ԁ ď",
    "e": "е ε é è ê ë ē є 3 €",
    "g": "ɡ 9",
    "h": "һ н",
    "i": "і ι í ì î ï ī ı 1 !",
    "j": "ј",
    "k": "к κ",
    "l": "ӏ ł |",
    "m": "м",
    "n": "п η ñ ń",
    "o": "о ο σ ó ò ô ö õ ø ō 0",
    "p": "р ρ",
    "r": "г ŕ",
    "s": "ѕ ś š 5 $",
    "t": "т τ 7 +",
    "u": "υ ц ú ù û ü ū",
    "v": "ν ѵ",
    "w": "ѡ ω ш",
    "x": "х χ",
    "y": "у γ ý ÿ",
    "z": "ž ź ż 2",
}
# Phrases whose words are harmless there.
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "pathetic fallacy", "sore loser rule", "pond scum", "oxy moron"]


class _Fold(dict):
    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        if code < 128:
            out = c.lower() if c.isalpha() else " "
        elif unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        else:
            small = unicodedata.normalize("NFKC", c).lower()
            out = "".join(self[ord(x)] if x != c else (x if x.isalpha() else " ") for x in small)
        self[code] = out
        return out


FOLD = _Fold({ord(x): to for to, own in LOOK_ALIKES.items() for x in own.split()})
_signs = re.compile(r"[!+|]+(?![^\W_])|(?<![^\W_])[!+|]+")


def folded(text: str) -> str:
    """Folded words, one space before and after each. Signs that stand for letters do so only beside letters on both sides."""
    if any(x in text for x in "!+|"):
        text = _signs.sub(" ", text)
    return f" {' '.join(text.translate(FOLD).split())} "


def patterns_of(text: str) -> set[str]:
    found = set()
    for word in {*folded(text).split()}:
        if 3 <= len(word) <= 24:
            found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if n < len(word))
    return found


COUNTED = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])


def _counted(batches):
    for batch in batches:
        both = Counter(), Counter()
        for text, toxic in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
            both[0 if toxic else 1].update(patterns_of(text or ""))
        names = list(both[0])  # what no toxic text here has can only lower weights; it is sent if it may matter
        names += [x for x in both[1] if x not in both[0]]
        yield batch_of(COUNTED, [names, [both[0][x] for x in names], [both[1][x] for x in names]])


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, fit=(0.0, 0.0, 0.0), empty: bool = False):
        self.weights, self.exceptions, self.fit, self.empty = weights, list(exceptions), tuple(fit), empty
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _automaton(self):
        if self._made is None:
            import ahocorasick

            self._made = ahocorasick.Automaton()
            for k, w in self.weights.items():
                self._made.add_word(k, (len(k.rstrip()), w))
            for x in self.exceptions:
                k = folded(x)
                self._made.add_word(k, (len(k.rstrip()), self._made.get(k, (0, 0.0))[1]) if k in self._made else (len(k.rstrip()), None))
            self._made.make_automaton()
        return self._made

    def features(self, text: str) -> tuple[float, float]:
        """The sum of the matches' weights, each word's strongest only, and that by log2 of the text's length in words."""
        if not self.weights or not text:
            return 0.0, 0.0
        line = folded(text)
        hits, free = {}, []
        for end, (size, weight) in self._automaton().iter(line):
            begin = line.rfind(" ", 0, end + 1 - (line[end] == " ")) if weight is not None else None
            if weight is None:
                free.append((end - size, end))
            else:
                hits[begin] = max(hits.get(begin, 0.0), weight)
        if free:
            hits = {a: w for a, w in hits.items() if not any(x <= a < y for x, y in free)}
        total = sum(hits.values())
        return total, total / np.log2(2 + line.count(" ")) if total else 0.0

    def score(self, text: str) -> float:
        if self.empty:
            return 0.0
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.fit[0] + self.fit[1] * np.log1p(a) + self.fit[2] * b, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method; a column of ones comes first in ``x``."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


FEATURE = T.StructType([T.StructField("toxic", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])


def _featured(shared):
    def run(batches):
        for batch in batches:
            found = [shared.value.features(x or "") for x in column(batch, "text")]
            yield batch_of(FEATURE, [batch.column(batch.schema.get_field_index("toxic")), [a for a, _ in found], [b for _, b in found]])

    return run


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> Lexicon:
    """The lexicon learnt from at most ``rows`` labelled rows of each label that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = written(known.where("toxic = 1").orderBy(*order).limit(rows).union(known.where("toxic = 0").orderBy(*order).limit(rows)), "sample")
    texts = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(12, "doc_id"), "labelled")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return Lexicon({}, exceptions, empty=True)
    counts = texts.mapInArrow(tidied(_counted), COUNTED).groupBy("pattern").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (p + 1.0)) - F.log((F.col("c") + 0.5) / (n + 1.0))
    found = counts.withColumn("w", weight).where((F.col("t") >= max(SUPPORT, SHARE * p)) & (F.col("w") >= LEAST)).collect()
    by = {r.pattern: r for r in found}
    weights = {}
    for name, r in by.items():
        # A longer pattern adds nothing where a beginning of it has as good a weight.
        shorter = [by[name[:k]] for k in range(2, len(name)) if name[:k] in by]
        if all(x.w < r.w - 0.5 for x in shorter):
            weights[name] = float(r.w)
    lexicon = Lexicon(weights, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    own = texts.select("text", "toxic").mapInArrow(tidied(lambda it: _featured(shared)(it)), FEATURE).toArrow().to_pandas()
    x = np.stack([np.ones(len(own)), np.log1p(own.a), own.b], axis=1)
    lexicon.fit = tuple(logistic(x, own.toxic.to_numpy(dtype=float)))
    return lexicon


SCORE = T.StructField(PRIVATE + "score", T.DoubleType())


def _scored(shared, names):
    def run(batches):
        for batch in pieces(batches):
            out = pa.array([shared.value.score(x or "") for x in column(batch, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), out], names=[*names, SCORE.name])

    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``__wl_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    return docs.mapInArrow(tidied(_scored(shared, docs.columns)), extended(docs, [SCORE]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    own = docs.select("doc_id", "text")
    out = scored(own, fit(own, labels)).select("doc_id", held_out().alias("held_out"), F.col(SCORE.name).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of THRESHOLD or more go."""
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, lexicon).where(F.col(SCORE.name) < THRESHOLD).select(*docs.columns)
