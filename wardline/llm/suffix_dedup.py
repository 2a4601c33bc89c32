"""Exact substring dedup: each byte covered by a LENGTH-byte string that also starts earlier goes.

A family of suffix arrays finds what starts earlier. Batches come to it in order of (document, start). A batch gets a suffix array
(positions sorted by what follows), which is merge-scanned against each existing level; a window of LENGTH bytes that is found
there, or earlier in the batch, is covered, and consecutive covered windows are a match of so many bytes more. What is new becomes
a level, and levels of about equal size merge, so that there are logarithmically many.

All windows of a corpus don't fit one family, so they are routed to many, by hashes that decide nothing but the way. The smallest
hash of the K-grams inside a window depends on its content alone, so equal windows have equal smallest hashes; consecutive windows of
a document with the same one, its anchor, form a run, about one for each forty bytes. First each part of the texts (PART bytes) has
a family of its own: runs whose anchor occurs there again, or twice in the run, go through it, and only what is new there goes on. So a
passage held by a third of all documents leaves a part once. Of these runs (anchor, document, start, number of windows) is shuffled.
The bytes of runs whose anchor occurs elsewhere too are fetched and go through the families of the anchors' partitions, which take all
else that is covered. An anchor with more than HOT runs of these is routed window by window, by the windows' own hashes, so that no
anchor fills a partition; a window's copies are one for each part at most.

Cases: a null or empty text has no bytes. Texts shorter than LENGTH lose nothing. Documents are ordered by doc_id; rows that
repeat a doc_id and its text count once and get the same result; other texts that share a doc_id are not earlier than one another where
they are equal at the same place, and each loses the places that are covered in any of them. A null doc_id loses nothing and causes no loss. Extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, attached, batch_of, column, discarded, joined, pieces, raw_text, tidied, written

LENGTH, K = 100, 24
#: Runs of an anchor from which on it is routed by windows; such an anchor has HEAVY runs at least in some parts.
HOT, HEAVY = 20_000, 8
#: Bytes of text that a part holds, of runs that a partition's families should hold, and windows of a batch of a family.
PART, FAMILY_BYTES, WINDOWS = 16 << 20, 4 << 20, 400_000
_rng = np.random.Generator(np.random.PCG64(7919))
BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
R = 0x9E3779B97F4A7C15 | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(R, n, 1 << 64))


class Grams:
    """Polynomial hashes of the substrings of ``data``, by their length."""

    def __init__(self, data: np.ndarray):
        self.of = {1: BYTES[data]}

    def hashes(self, length: int) -> np.ndarray:
        if length not in self.of:
            left = 1 << length.bit_length() - 1
            left = left // 2 if left == length else left
            a, b = self.hashes(left), self.hashes(length - left)
            n = max(0, len(self.of[1]) - length + 1)
            self.of[length] = a[:n] * _power(length - left) + b[left : left + n]
        return self.of[length]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n, step = len(values) - width + 1, 1
    while step * 2 <= width:
        values = np.minimum(values[: len(values) - step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step : width - step + n])


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the smallest hash of its k-grams; and the hashes of all k-grams."""
    h = Grams(data).hashes(k)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return smallest(h, length - k + 1), h


def twice(h: np.ndarray, least: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Whether a run's smallest hash occurs more than once in its windows, which begin at starts..ends-1 and have ``width`` hashes."""
    edge = np.zeros(width - 1, dtype=np.uint64)
    largest = ~smallest(~np.concatenate((edge, least, edge)), width)
    places = np.flatnonzero(largest == h)  # the smallest of some window
    values, own = np.unique(h[places], return_inverse=True)
    keys = np.sort(own.astype(np.int64) << 40 | places)
    group = np.searchsorted(values, least[starts]).astype(np.int64) << 40
    second = np.searchsorted(keys, group | starts) + 1
    return (second < len(keys)) & (keys[np.minimum(second, len(keys) - 1)] < (group | ends + width - 1))


RUN = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])


def runs_of(texts: list[bytes], length: int, k: int) -> list[np.ndarray]:
    """The runs of some texts: anchor, number of the text, start, number of windows, and whether the anchor occurs twice in it."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    least, h = anchors(np.frombuffer(data, dtype=np.uint8), length, k)
    # The windows that cross documents are no windows.
    valid = np.ones(len(least) + 1, dtype=bool)
    valid[-1] = False
    for end in (begins + sizes)[:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    new = np.concatenate(([True], (least[1:] != least[:-1]) | ~valid[:-2])) & valid[:-1]
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(~valid)
    ends = np.minimum(np.append(starts[1:], len(least)), stop[np.searchsorted(stop, starts)])
    owner = np.searchsorted(begins, starts, side="right") - 1
    return [least[starts].view(np.int64), owner, (starts - begins[owner]), ends - starts, twice(h, least, starts, ends, length - k + 1)]


def _grouped(texts: list[bytes], limit: int = 1 << 19):
    """Numbers of consecutive texts, of about ``limit`` bytes together."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size > limit:
            yield first, at + 1
            first, size = at + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _local(length: int, k: int):
    """Rows (anchor, document, start, n) for runs that go on, without an anchor for n windows that are covered, and without a document
    for an anchor of n runs in this part, where that are HEAVY or more."""

    def run(batches):
        for batch in joined(batches, PART):
            own = sorted({(d, t) for d, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True) if d is not None and t and len(t) >= length})
            if not own:
                continue
            texts = [t for _, t in own]
            docs = np.array([d for d, _ in own], dtype=np.int64)
            found = []
            for a, b in _grouped(texts):
                one = runs_of(texts[a:b], length, k)
                one[1] += a
                found.append(one)
            anchor, text, start, n, again = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(anchor, kind="stable")
            same = anchor[order][1:] == anchor[order][:-1]
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            out = [[anchor[~again], docs[text[~again]], start[~again], n[~again]]]
            covers = []
            for old, new in _looked_up(np.flatnonzero(again), texts, docs, anchor, text, start, n, length):
                covers.append(old)
                out.append(new)
            kept, heavy = np.unique(np.concatenate([x[0] for x in out]), return_counts=True)
            kept, heavy = kept[heavy >= HEAVY], heavy[heavy >= HEAVY]
            goes = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield batch_of(RUN, [goes[0], goes[1], goes[2].astype(np.int32), goes[3].astype(np.int32)])
            yield batch_of(RUN, [kept, pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.int32()), heavy.astype(np.int32)])
            for doc, begin, size in covers:
                yield batch_of(RUN, [pa.nulls(len(doc), pa.int64()), doc, begin.astype(np.int32), size.astype(np.int32)])

    return run


def _looked_up(rows, texts, docs, anchor, text, start, n, length: int):
    """The rows' runs, in batches through a family: (document, start, n) of covered windows, and (anchor, document, start, n) of the others."""
    family = Family(length)
    total = np.cumsum(n[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WINDOWS, side="right")))
        own = rows[at:to]
        # Runs at the same place of texts that share a doc_id come together, in order.
        while to < len(rows) and docs[text[rows[to]]] == docs[text[own[-1]]]:
            to += 1
            own = rows[at:to]
        at = to
        sizes, doc = n[own], docs[text[own]]
        # Runs that follow one another in a text come as one.
        joint = np.concatenate(([True], (text[own][1:] != text[own][:-1]) | (start[own][1:] != (start[own] + sizes)[:-1])))
        whole = np.add.reduceat(sizes, np.flatnonzero(joint))
        data = [texts[t][a : a + m + length - 1] for t, a, m in zip(text[own][joint].tolist(), start[own][joint].tolist(), whole.tolist(), strict=True)]
        earlier = family.add(data, doc[joint], start[own][joint])
        (who, begin, size), (who2, begin2, size2) = _stretches(earlier, sizes), _stretches(~earlier, sizes)
        yield (doc[who], start[own][who] + begin, size), (anchor[own][who2], doc[who2], start[own][who2] + begin2, size2)


def _stretches(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of consecutive true flags inside each run: the run's number, where in it, and how many."""
    at = np.cumsum(sizes) - sizes
    first = np.zeros(len(flags), dtype=bool)
    first[at] = True
    last = np.append(first[1:], True)
    begin = np.flatnonzero(flags & (first | ~np.concatenate(([False], flags[:-1]))))
    end = np.flatnonzero(flags & (last | ~np.append(flags[1:], False))) + 1
    who = np.searchsorted(at, begin, side="right") - 1
    return who, begin - at[who], end - begin


FETCHED = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _fetch(length: int):
    def run(batches):
        for batch in pieces(batches, 4 << 20):
            rows = []
            for doc, text, runs in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "runs"), strict=True):
                text = text or b""
                for r in runs:
                    at, n = r["start"], r["n"]
                    if at + n + length - 1 > len(text):
                        continue  # of another text with this doc_id
                    if not r["hot"]:
                        rows.append((r["anchor"], doc, at, text[at : at + n + length - 1]))
                        continue
                    own = Grams(np.frombuffer(text[at : at + n + length - 1], dtype=np.uint8)).hashes(length).view(np.int64)
                    rows += [(key, doc, at + j, text[at + j : at + j + length]) for j, key in enumerate(own.tolist())]
            yield batch_of(FETCHED, list(zip(*rows, strict=True)) or [[]] * 4)

    return run


class Level:
    """A suffix array: bytes, and the sorted positions of distinct windows in them."""

    def __init__(self, data: np.ndarray, array: np.ndarray, length: int):
        self.data, self.array, self.length = data, array, length
        # Eight bytes from each position on as one number that compares like them.
        self.eights = np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,))
        self.offsets = [*range(0, length - 7, 8), *([length - 8] if length > 8 and length % 8 else [])] or [0]
        self.first = self.word(array, 0)

    def word(self, at: np.ndarray, offset: int) -> np.ndarray:
        found = self.eights[at + offset].astype(np.uint64)
        return found >> np.uint64(8 * (8 - self.length)) if self.length < 8 else found

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``other``, in its order, how many of the own ones are smaller, and whether one is equal."""
        low, high = (np.searchsorted(self.first, other.first, side=side) for side in ("left", "right"))
        for offset in self.offsets[1:]:
            rows = np.flatnonzero(low < high)
            if not len(rows):
                break
            want = other.word(other.array[rows], offset)
            one = high[rows] - low[rows] == 1
            own = self.word(self.array[low[rows[one]]], offset)
            # One candidate either goes on, or is smaller or larger.
            low[rows[one]] += own < want[one]
            high[rows[one]] -= own > want[one]
            rows, want = rows[~one], want[~one]
            if len(rows):
                low[rows], high[rows] = self._bound(low[rows], high[rows], want, offset, False), self._bound(low[rows], high[rows], want, offset, True)
        return low, low < high

    def _bound(self, a: np.ndarray, b: np.ndarray, want: np.ndarray, offset: int, after: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while len(rows := np.flatnonzero(a < b)):
            mid = (a[rows] + b[rows]) >> 1
            own = self.word(self.array[mid], offset)
            up = own <= want[rows] if after else own < want[rows]
            a[rows[up]] = mid[up] + 1
            b[rows[~up]] = mid[~up]
        return a

    def merged(self, other: Level) -> Level:
        """The level of both, which share no window."""
        at, _ = self.places(other)
        data = np.concatenate((self.data, other.data))
        return Level(data, np.insert(self.array, at, other.array + len(self.data)), self.length)


def arranged(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """The windows of an unsorted level in order, by eight bytes and ties alone by the next eight, and which differ from the one before."""
    order = np.argsort(level.first)
    found = level.first[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    for offset in level.offsets[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = level.word(level.array[order[at]], offset)
        group = np.cumsum(new[at]) - 1
        same = group[1:] == group[:-1]
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[1:][same & (own[1:] != own[:-1])]] = True
        rows = np.flatnonzero(mixed[group])
        if len(rows):
            place = np.empty(len(rows), dtype=np.int64)
            place[np.argsort(own[rows])] = np.arange(len(rows))
            by = rows[np.argsort(group[rows] << 32 | place)]
            order[at[rows]], own[rows] = order[at[by]], own[by]
        new[at] = np.concatenate(([True], ~same | (own[1:] != own[:-1])))
    return order, new


class Family:
    """Suffix arrays of all that was added, in levels whose sizes grow geometrically."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels = length, []

    def add(self, runs: list[bytes], docs=None, places=None) -> np.ndarray:
        """For each window of each run, in order, whether it came earlier; afterwards all of them are in the family. With ``docs`` and
        ``places``, where the runs begin, an equal window at the same place of the same document isn't earlier."""
        kinds = {r: None for r in runs}
        for k, r in enumerate(kinds):
            kinds[r] = k
        kind = np.array([kinds[r] for r in runs])
        first = np.unique(kind, return_index=True)[1]
        docs, places = (np.arange(len(runs)), np.zeros(len(runs), dtype=np.int64)) if docs is None else (np.asarray(docs), np.asarray(places, dtype=np.int64))
        # Equal runs have the same suffixes: the array is that of the different ones, in their order.
        sizes = np.array([len(r) for r in kinds])
        begins, counts = np.cumsum(sizes) - sizes, sizes - self.length + 1
        before = np.cumsum(counts) - counts
        run = np.repeat(np.arange(len(kinds)), counts)
        inside = np.arange(counts.sum()) - before[run]
        starts = begins[run] + inside
        data = np.frombuffer(b"".join([*kinds, bytes(8 + self.length)]), dtype=np.uint8)
        order, new = arranged(Level(data, starts, self.length))
        group = np.empty(len(starts), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        # The first of each kind of window as they came.
        lead = np.minimum.reduceat(order, np.flatnonzero(new))
        own = Level(data[: sizes.sum() + 8], starts[lead], self.length)
        known = np.zeros(len(lead), dtype=bool)
        for level in self.levels:
            known |= level.places(own)[1]
        each = counts[kind]
        at = np.repeat(before[kind], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        to = lead[group[at]]
        earlier = known[group[at]] | (np.repeat(docs, each) != docs[first][run[to]]) | (np.repeat(places, each) + inside[at] != places[first][run[to]] + inside[to])
        if not known.all():
            self.levels.append(Level(own.data, own.array[~known], self.length))
        while len(self.levels) > 1 and len(self.levels[-2].array) <= 2 * len(self.levels[-1].array):
            small = self.levels.pop()
            self.levels.append(self.levels.pop().merged(small))
        return earlier


COVER = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])


def _families(length: int):
    def run(batches):
        family, waiting, size = Family(length), [], 0
        for batch in batches:
            for row in zip(*(column(batch, c) for c in ("doc_id", "start", "data")), strict=True):
                # Rows of one document and start come together and are looked up in the same batch.
                if size > WINDOWS and row[:2] != waiting[-1][:2]:
                    yield _covers(family, waiting, length)
                    waiting, size = [], 0
                if not (waiting and waiting[-1] == row):
                    waiting.append(row)
                    size += len(row[2]) - length + 1
        if waiting:
            yield _covers(family, waiting, length)

    return run


def _covers(family: Family, rows: list, length: int) -> pa.RecordBatch:
    doc, start = (np.array([r[j] for r in rows], dtype=np.int64) for j in (0, 1))
    earlier = family.add([r[2] for r in rows], doc, start)
    who, begin, n = _stretches(earlier, np.array([len(r[2]) - length + 1 for r in rows]))
    return batch_of(COVER, [doc[who], (start[who] + begin).astype(np.int32), n.astype(np.int32)])


def covered(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, start, n): n windows from the byte ``start`` on that also start earlier."""
    docs = docs.select("doc_id", "text")
    runs = written(raw_text(docs).mapInArrow(tidied(_local(length, k)), RUN), "runs")
    alive = runs.where("anchor is not null and doc_id is not null")
    # At most HOT_KEYS anchors have so many runs.
    limit = max(hot, alive.count() // HOT_KEYS)
    busy = written(runs.where("doc_id is null").groupBy("anchor").agg(F.sum("n").alias("k")).where(F.col("k") > limit).select("anchor"), "busy")
    many = F.count("*").over(Window.partitionBy("anchor"))
    some = alive.join(F.broadcast(busy), "anchor", "left_anti").withColumn("k", many).where("k > 1").select(*RUN.names, F.lit(False).alias("hot"))
    shared = written(some.union(alive.join(F.broadcast(busy), "anchor").select(*RUN.names, F.lit(True))), "shared")
    count, size = shared.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("hot"), F.col("n") * length).otherwise(F.col("n") + length)), F.lit(0))).first()
    wanted = written(shared.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("runs")), "wanted")
    discarded(shared, busy)
    own = attached(raw_text(docs), wanted, "id", 64 * count).where("runs is not null").select("doc_id", "text", "runs")
    parts = max(8, -(-size // FAMILY_BYTES))
    found = own.mapInArrow(_fetch(length), FETCHED).repartition(parts, "key").sortWithinPartitions("doc_id", "start", "data").mapInArrow(tidied(_families(length)), COVER)
    out = written(found.union(runs.where("anchor is null").select(*COVER.names)), "covers")
    discarded(runs, wanted)
    return out


REMOVED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(length: int):
    def run(batches):
        for batch in pieces(batches):
            rows = []
            for doc, text, ranges in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "ranges"), strict=True):
                text = text or b""
                spans = united([(r["start"], min(len(text), r["start"] + r["n"] + length - 1)) for r in ranges or []])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(kept), len(spans), kept))
            yield batch_of(REMOVED, list(zip(*rows, strict=True)) or [[]] * 5)

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are kept, for each row."""
    found = covered(docs, length, k, hot)
    ranges = written(found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "ranges")
    size = ranges.agg(F.coalesce(F.sum(F.size("ranges") + 2), F.lit(0))).first()[0]
    discarded(found)
    return attached(raw_text(docs.select("doc_id", "text")), ranges, "id", 32 * size).select("doc_id", "text", "ranges").mapInArrow(tidied(_remove(length)), REMOVED)
