"""Benchmark decontamination by a generalised suffix automaton of the items' words.

Documents are streamed through the automaton of a block of items, which gives at each word the longest match that ends
there. A window is WINDOW words of an item, or a whole shorter item. Words inside an occurring window are hit; the items
with occurring windows are known from the automaton's states. An automaton is kept in flat arrays and broadcast. A block's items
take BLOCK_BYTES at most by a bound of WORD_BYTES a word (2 states and 3 transitions of 12 bytes each, and the vocabulary); a longer
item is cut into parts that share all but one word of a window. So what is broadcast is bounded whatever the benchmark's size.
With more than one block, each passes over the documents by itself and what it hits is written; the hits are united at the end. So a
task has one automaton at a time.

Cases: null texts have no words. Items without words match nothing. Equal items count one each; rows that repeat an
item_id count as one item, and so do all rows without one, which has no name among the items found. Rows that repeat a doc_id are each
returned. Words are compared whole. Extra columns are left behind by ``verdicts`` and kept by ``stage``; there, of a document that isn't
contaminated the hit words are cut out.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, attached, batch_of, column, discarded, extended, free_name, pieces, tidied, written

WINDOW, COVER = 13, 20
WORD_BYTES, BLOCK_BYTES = 100, 16 << 20
#: A-Z lower-cased; all other ASCII but digits and a-z divides words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class _Builder:
    """A suffix automaton of several word sequences, a dictionary a state. It lives on the driver for one block."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for _, item in items:
            for w in item:
                self.number.setdefault(w, len(self.number))
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, self.number[w])
        for name, item in items:
            state = 0
            for k, w in enumerate(item, 1):
                state = self.next[state][self.number[w]]
                if k >= window:
                    self.ends.setdefault(state, set()).add(name)
            if 0 < len(item) < window:
                self.short.setdefault(state, set()).add(name)
        # A state whose strings span the window's length has the items of all states below it in the tree of links.
        for state in sorted(self.ends, key=self.length.__getitem__, reverse=True):
            at = state
            while self.length[self.link[at]] >= window:
                at = self.link[at]
                self.ends.setdefault(at, set()).update(self.ends[state])

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1


class Automaton:
    """A suffix automaton in flat arrays: transitions sorted by state and word, links, lengths, and the items of each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        made = _Builder(items, window)
        self.window, self.number = window, made.number
        self.link, self.length = array("i", made.link), array("i", made.length)
        moves = sorted((state << 32 | w, q) for state, to in enumerate(made.next) for w, q in to.items())
        self.keys, self.to = array("q", [k for k, _ in moves]), array("i", [q for _, q in moves])
        self.names = list(dict.fromkeys(name for name, _ in items))
        place = {name: k for k, name in enumerate(self.names)}
        self.end_states, self.end_first, self.end_items = _grouped(made.ends, place)
        self.short_states, self.short_first, self.short_items = _grouped(made.short, place)
        # The nearest state on the way along links, itself included, at which a short item ends.
        self.above = array("i", [-1]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[state] = state if state in made.short else self.above[self.link[state]]
        self.least = min([window, *(len(x) for _, x in items if x)])

    def bytes(self) -> int:
        """What the arrays and the vocabulary take."""
        arrays = [x for x in vars(self).values() if isinstance(x, array)]
        return sum(len(x) * x.itemsize for x in arrays) + sum(len(w) + 60 for w in self.number) + sum(len(x or "") + 60 for x in self.names)

    def _step(self, state: int, w: int) -> int:
        """The state after a word, -1 if there is none."""
        key = state << 32 | w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _ends(self, state: int) -> array:
        at = bisect_left(self.end_states, state)
        return self.end_items[self.end_first[at] : self.end_first[at + 1]]

    def _shorts(self, state: int) -> array:
        at = bisect_left(self.short_states, state)
        return self.short_items[self.short_first[at] : self.short_first[at + 1]]

    def ranges(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The ranges of words that are hit, joined and in order, and the items with occurring windows."""
        get = self.number.get
        ids = [get(w, -1) for w in found]
        spans, items, n = [], set(), len(ids)
        if n < self.least:
            return spans, set()
        known = np.flatnonzero(np.diff(np.concatenate(([0], (np.array(ids) >= 0).view(np.int8), [0]))))
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - begin >= self.least:
                self._stream(ids, begin, end, spans, items)
        return spans, {self.names[k] for k in items}

    def _stream(self, ids, begin, end, spans, items) -> None:
        link, length, window = self.link, self.length, self.window
        state, matched = 0, 0
        for at in range(begin, end):
            w = ids[at]
            while (q := self._step(state, w)) < 0 and state:
                state = link[state]
                matched = length[state]
            if q >= 0:
                state = q
                matched += 1
            hit = 0
            if matched >= window:
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                items.update(self._ends(top))
                hit = window
            # Short items end at states on the way along links; in the state itself only if its whole length is matched.
            near = -1
            if state:
                near = self.above[state]
                if near == state and matched < length[state]:
                    near = self.above[link[state]]
            while near > 0:
                items.update(self._shorts(near))
                hit = max(hit, length[near])
                near = self.above[link[near]]
            if hit:
                a = at + 1 - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, at + 1))


def _grouped(sets: dict[int, set], place: dict) -> tuple[array, array, array]:
    """States in order, where the items of each begin, and the items."""
    states = sorted(sets)
    first, items = array("i", [0]), array("i")
    for state in states:
        items.extend(sorted(place[x] for x in sets[state]))
        first.append(len(items))
    return array("i", states), first, items


def blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES):
    """The items with words, streamed through the driver, in lists that take about ``limit`` bytes at most."""
    own, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct().orderBy("item", "text")
    for row in rows.toLocalIterator():
        found = words(bytes(row.text) if row.text is not None else None)
        step = max(1, limit // WORD_BYTES)
        for a in range(0, max(1, len(found) - window + 1), step):
            part = found[a : a + step + window - 1]
            cost = WORD_BYTES * len(part) + sum(map(len, part))
            if own and size + cost > limit:
                yield own
                own, size = [], 0
            if part:
                own.append((row.item, part))
                size += cost
    yield own


def automata(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES):
    """The blocks' automata. One that takes over twice the limit, as many items share its states, is made anew from two halves."""
    for block in blocks(benchmark, window, limit):
        open_ = [block]
        while open_:
            own = open_.pop()
            made = Automaton(own, window)
            if len(own) > 1 and made.bytes() > 2 * limit:
                open_ += [own[len(own) // 2 :], own[: len(own) // 2]]
            else:
                yield made


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
FOUND = T.StructType([T.StructField("key", T.StringType()), *HITS.fields[1:]])


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _named(items: set) -> list:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    return [x for s in spans for x in s]


def _block_hits(shared):
    """What a block's automaton hits, of the texts where it hits anything."""

    def run(batches):
        automaton = shared.value
        for batch in pieces(batches):
            rows = []
            for key, text in zip(column(batch, "key"), column(batch, "text"), strict=True):
                spans, items = automaton.ranges(words(text))
                if spans:
                    rows.append((key, _flat(spans), _named(items)))
            yield batch_of(FOUND, list(zip(*rows, strict=True)) or [[]] * 3)

    return run


def _scan(names: list[str], raw: str, out: str, shared=None, found: str | None = None):
    """Adds the hits: those of the one automaton, or those that were found before."""

    def run(batches):
        for batch in pieces(batches, column=raw):
            rows = []
            before = column(batch, found) if found else [None] * batch.num_rows
            for text, own in zip(column(batch, raw), before, strict=True):
                w = words(text)
                if shared is not None:
                    spans, items = shared.value.ranges(w)
                else:
                    spans = _united([s for x in own or [] for s in zip(x["spans"][::2], x["spans"][1::2], strict=True)])
                    items = {i for x in own or [] for i in x["items"]}
                rows.append({"n_words": len(w), "spans": _flat(spans), "items": _named(items)})
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(rows, type=arrow_type(HITS))], names=[*names, out])

    return run


def _followed(first, then):
    """Both functions of mapInArrow in one worker."""
    return tidied(lambda batches: then(first(batches))) if then else tidied(first)


def scan(docs: DataFrame, benchmark: DataFrame, out: str, window: int = WINDOW, limit: int = BLOCK_BYTES, then=None) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, the hit ranges of words (from, to, from, to, ...) and the items found. Or what ``then``, a
    function of mapInArrow, makes of that in the same workers, with the columns of ``docs``."""
    spark, raw, key = docs.sparkSession, free_name(docs, "raw"), free_name(docs, "key")
    schema = extended(docs, [] if then else [T.StructField(out, HITS)])
    texts = docs.withColumn(raw, F.col("text").cast("binary"))
    made = automata(benchmark, window, limit)
    first, second = next(made), next(made, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return texts.mapInArrow(_followed(_scan(docs.columns, raw, out, shared), then), schema)
    # Rows are known by doc_id and text: copies of one text part, and rows that repeat both have the same hits.
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary")))
    tables, keyed = [], docs.select(named.alias("key"), F.col("text").cast("binary").alias("text")).where("text is not null")
    for automaton in _chain(first, second, made):
        shared = spark.sparkContext.broadcast(automaton)
        tables.append(written(keyed.mapInArrow(tidied(_block_hits(shared)), FOUND), "block-hits"))
        shared.unpersist()
    found = free_name(docs, "found")
    once = reduce(DataFrame.union, tables).groupBy("key").agg(F.collect_set(F.struct("spans", "items")).alias(found)).withColumnRenamed("key", key + "2")
    once = written(once, "hits")
    size = once.agg(F.count("*"), F.coalesce(F.sum(F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.size(x["spans"]) + F.size(x["items"]))), F.lit(0))).first()
    discarded(*tables)
    joined = attached(texts.withColumn(key, named), once, key + "2", 100 * size[0] + 32 * size[1], by=key)
    return joined.mapInArrow(_followed(_scan(docs.columns, raw, out, found=found), then), schema)


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, the items and whether the document is contaminated: at least one word of ``cover`` is hit."""
    found = scan(docs.select("doc_id", "text"), benchmark, "hits", window, limit)
    hit = F.aggregate(F.transform("hits.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.select("doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.col("hits.items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (cover * F.col("n_hit") >= F.col("n_words")))


def without(text: bytes, spans: list[int]) -> bytes:
    """The text without the words in the ranges; what stood between words that stay is kept."""
    import re

    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(TABLE))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def _cut(names: list[str], found: str, cover: int):
    def run(batches):
        for batch in pieces(batches):
            hits, texts = column(batch, found), column(batch, "text")
            keep, new = [], []
            for k, (h, text) in enumerate(zip(hits, texts, strict=True)):
                n = sum(h["spans"][1::2]) - sum(h["spans"][::2])
                if n and cover * n >= h["n_words"]:
                    continue
                keep.append(k)
                new.append(without(text.encode(), h["spans"]).decode() if n else text)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)).take(rows) for c in names], names=names)

    return run


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; from the others the words that are hit are cut out."""
    from .line_dedup import with_length

    out = free_name(docs, "hits")
    kept = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out, then=_cut(docs.columns, out, COVER))
    return with_length(kept).select(*docs.columns)
