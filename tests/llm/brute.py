"""Plain versions of the operators, for small inputs. A document is (doc_id, text or None)."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def line_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, n, percent=80):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(docs, items, window=13):
    windows = defaultdict(set)
    for name, text in items:
        w = item_words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(name)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), sorted(hit), sorted(map(str, found)))
    return out


def substrings(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (w := b[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def ogg_crc(data):
    x = 0
    for c in data:
        x ^= c << 24
        for _ in range(8):
            x = (x << 1 ^ (0x04C11DB7 if x & 0x80000000 else 0)) & 0xFFFFFFFF
    return x


def unigram(docs):
    """Rows are learnt from one by one, those that repeat a doc_id too; such rows have the same text here."""
    tokens = {d: [*words(t), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(w for d, t in docs if not held[d] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t in tokens.items()}


class Ppm:
    """PPM with escape method C, full counts and exclusion, a symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            for context, symbol in self.symbols(t):
                for k in range(order + 1):
                    self.counts[context[order - k :]][symbol] += 1

    def symbols(self, text):
        b = bytes(self.order) + text
        for i in range(self.order, len(b)):
            yield b[i - self.order : i], b[i]
        yield b[len(b) - self.order :], 256

    def chance(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            own = self.counts.get(context[self.order - k :])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out * left[symbol] / total
            out *= len(left) / total
            excluded |= set(left)
        return out / (257 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.chance(c, s)) for c, s in self.symbols(text))


def lexicon(learnt, module):
    """Weights of patterns from (text, toxic) rows, by loops; constants, folding and exceptions are the module's fixed values."""
    both = Counter(), Counter()
    sizes = Counter(toxic for _, toxic in learnt)
    if not sizes[0] or not sizes[1]:
        return {}
    for text, toxic in learnt:
        found = set()
        for word in set(module.folded(text or "").split(" ")) - {""}:
            if 3 <= len(word) <= 24:
                found.add(" " + word + " ")
            for n in module.BEGINNINGS:
                if len(word) > n:
                    found.add(" " + word[:n])
        both[toxic].update(found)
    weights = {}
    for pattern, t in both[1].items():
        w = math.log((t + 0.5) / (sizes[1] + 1)) - math.log((both[0][pattern] + 0.5) / (sizes[0] + 1))
        if t >= module.SUPPORT and t >= module.SHARE * sizes[1] and w >= module.LEAST:
            weights[pattern] = w
    return {p: w for p, w in weights.items() if not any(len(q) < len(p) and p.startswith(q) and weights[q] >= w - 0.5 for q in weights)}


def toxicity(text, weights, fit, module):
    """The score of a text: each word's strongest pattern that isn't inside an exception phrase, by a loop over words and patterns."""
    if not weights:
        return 0.0 if fit == (0.0, 0.0, 0.0) else 1 / (1 + math.exp(-fit[0]))
    line = module.folded(text) if text else ""
    at, total = 0, 0.0
    free = set()
    for phrase in module.EXCEPTIONS:
        own = module.folded(phrase)
        i = line.find(own)
        while i >= 0:
            free.update(range(i, i + len(own) - 1))
            i = line.find(own, i + 1)
    for word in line.split(" ")[1:-1] if line.strip() else []:
        own = f" {word} "
        best = max((w for p, w in weights.items() if own.startswith(p)), default=0.0)
        total += 0.0 if at in free else best
        at += len(word) + 1
    scaled = total / math.log2(2 + line.count(" ")) if total else 0.0
    return 1 / (1 + math.exp(-min(30, max(-30, fit[0] + fit[1] * math.log1p(total) + fit[2] * scaled))))


def url(text, rules, weights, bias):
    """host, path, rule, verdict and score of a URL."""
    host = path = ""
    if text and "://" in text:
        rest = text[text.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
    total = n = 0
    for kind, own in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for size in (3, 4):
            for i in range(len(own) - size + 1):
                total += weights[int.from_bytes(hashlib.md5((kind + own[i : i + size]).encode()).digest()[:2], "big") % len(weights)]
                n += 1
    score = 1 / (1 + math.exp(-(bias + total / max(1, n))))
    best = None
    for h, p, v in rules:
        if path.startswith(p) and ("." + host).endswith("." + h) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best[1] if best else "block" if score >= 0.5 else "allow", score
