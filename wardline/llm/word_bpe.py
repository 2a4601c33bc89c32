"""Ids of many plain words at once.

A word of Latin-1 letters, with or without one comma or full stop behind it, needs of the tokenizer only lower case and byte-pair
merges. These are done here for whole arrays of words: all words merge their pair of lowest rank, the leftmost first, until
none has any left. The vocabulary and merges are the tokenizer's own. Other words are left to the tokenizer.
"""

from __future__ import annotations

import json

import numpy as np

#: Most bytes of a word that is done here, without its mark.
LONGEST = 40
NONE, PAD = 1 << 30, (1 << 20) - 1


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run of ``count``, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in byte_names()], dtype=np.int32)
        self.outer = np.array([vocabulary[c + end] for c in byte_names()], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        new = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        rank = np.arange(len(keys), dtype=np.int32)
        # Open addressing: where a pair's slot is taken it goes to the next one.
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.new = np.zeros(1 << self.bits, dtype=np.int32)
        self.most, left = 0, np.arange(len(keys))
        while left.size:
            slot = self._slot(keys[left], self.most)
            free = self.keys[slot] == -1
            own, at = np.unique(slot[free], return_index=True)
            put = left[free][at]
            self.keys[own], self.rank[own], self.new[own] = keys[put], rank[put], new[put]
            left = np.setdiff1d(left, put)
            self.most += 1

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        hashed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (hashed.astype(np.int32) + step) & (1 << self.bits) - 1

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE if it has none, and the slot."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key, 0)
        held = self.keys[slot]
        same = held == key
        rank = np.where(same, self.rank[slot], np.int32(NONE))
        open_ = np.flatnonzero(~same & (held != -1))
        for step in range(1, self.most):
            if not open_.size:
                break
            next_ = self._slot(key[open_], step)
            held = self.keys[next_]
            ok = held == key[open_]
            rank[open_[ok]], slot[open_[ok]] = self.rank[next_[ok]], next_[ok]
            open_ = open_[~ok & (held != -1)]
        return rank, slot

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, marks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are plain, their numbers of ids, their ids one after the other).

        Word i is the UTF-8 bytes data[start[i] : start[i] + size[i]]; marks: ids of the comma and the full stop by code.
        """
        last = data[start + np.maximum(size, 1) - 1] if len(size) else np.zeros(0, np.uint8)
        mark = np.where(np.isin(last, list(marks)) & (size > 1), last, 0)
        stem = size - (mark > 0)
        short = np.flatnonzero((stem > 0) & (stem <= LONGEST))
        found = []
        order = short[np.argsort(stem[short], kind="stable")]
        for own in np.array_split(order, max(1, len(order) // 8192)):
            if own.size:
                found.append(self._part(data, start[own], stem[own], mark[own], marks, own))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _part(self, data, start, stem, mark, marks, own):
        at = np.arange(int(stem.max()))
        raw = data[np.minimum(start[:, None] + at, len(data) - 1)]
        inside = at < stem[:, None]
        lead = raw == 0xC3
        second = np.zeros_like(lead)
        second[:, 1:] = lead[:, :-1]
        letter = ((raw | 32) - np.uint8(97) < 26) & (raw < 128)
        ok = ((letter | lead | second & (raw != 0x97) & (raw != 0xB7)) | ~inside).all(axis=1)
        raw, inside, second, letter, stem, mark, own = (x[ok] for x in (raw, inside, second, letter, stem, mark, own))
        raw = np.where(letter | second & (raw <= 0x9E), raw | 32, raw)
        ids = self._merge(raw, inside, stem)
        count = (ids != PAD).sum(axis=1)
        width = ids.shape[1]
        more = max(map(len, marks.values()))
        whole = np.full((len(own), width + more), PAD, dtype=np.int32)
        whole[:, :width] = ids
        for code, x in marks.items():
            whole[mark == code, width : width + len(x)] = x
            count = count + len(x) * (mark == code)
        return own, count, whole[whole != PAD].astype(np.uint32)

    def _merge(self, raw: np.ndarray, inside: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols of each row after all merges. A symbol stays at its first byte's place; the places it has taken in are PAD."""
        rows, n = raw.shape
        at = np.arange(n)
        # Two more columns stand for what lies beyond either end: n behind and n + 1 before.
        wide = n + 2
        symbols = np.full((rows, wide), PAD, dtype=np.int32)
        symbols[:, :n] = np.where(at == size[:, None] - 1, self.outer[raw], self.inner[raw])
        symbols[:, :n][~inside] = PAD
        rank, slot = np.full((rows, wide), NONE, dtype=np.int32), np.zeros((rows, wide), dtype=np.int32)
        found = self._find(symbols[:, :n].ravel(), symbols[:, 1 : n + 1].ravel())
        rank[:, :n], slot[:, :n] = (x.reshape(rows, n) for x in found)
        after = np.broadcast_to(np.concatenate([at + 1, [n, 0]]), (rows, wide)).astype(np.int32, order="C")
        before = np.broadcast_to(np.concatenate([[n + 1], at, [n + 1]]), (rows, wide)).astype(np.int32, order="C")
        out, live = symbols[:, :n].copy(), np.arange(rows)
        while live.size:
            j = rank.argmin(axis=1)
            go = np.flatnonzero(rank[np.arange(len(live)), j] < NONE)
            if 4 * go.size < 3 * live.size or not go.size:
                out[live] = symbols[:, :n]
                live, symbols, rank, slot, after, before, j = (x[go] for x in (live, symbols, rank, slot, after, before, j))
                go = np.arange(len(live))
            base = go * wide
            f = base + j[go]
            s, r, o, a, b = (x.reshape(-1) for x in (symbols, rank, slot, after, before))
            taken = base + a[f]
            then = a[taken]
            s[f] = self.new[o[f]]
            s[taken], r[taken] = PAD, NONE
            a[f], b[base + then] = then, j[go]
            prior = b[f]
            left = np.concatenate([f, base + prior])
            r[left], o[left] = self._find(s[left], np.concatenate([s[base + then], s[f]]))
        return out
