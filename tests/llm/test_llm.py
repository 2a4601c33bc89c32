import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from wardline.llm import common, decontaminate, line_dedup, near_dup, ogg, packing, ppm, queries, sharding, suffix_dedup, toxicity, url_filter

EDGE = "a line that is longer than forty characters, Repeated"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def edge(tmp_path_factory, spark):
    """A folder of tables with nulls, empty and long texts, ties, repeated lines and rows, and columns with awkward names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)] + ["straße", "año", "ΣΊΣ"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = text(300)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "one two"), (5, "ONE  two\n"), (6, EDGE), (7, "x" * 500), (8, "\0\1\x7f <|endoftext|> 'sà  y")]
    rows += [(10 + k, f"{text(30)}\n  {EDGE.upper()} \r\n{text(20)}\n{EDGE}") for k in range(8)]
    rows += [(30 + k, base if k < 3 else base.replace(" ", f" w{k} ", k)) for k in range(12)]
    rows += [(50, text(20_000)), (51, "ab" * 300 + text(50)), (52, "ab" * 300)]
    items = [(k, text(25)) for k in range(4)] + [(4, "just four little words"), (5, ""), (6, None)]
    items.append((7, items[0][1]))
    items.append((8, " ".join(items[1][1].split()[3:20])))
    rows += [(60, f"{text(40)} {items[0][1]} {text(10)}"), (61, f"{text(500)} {' '.join(items[1][1].split()[2:17])} Just, FOUR little words {text(9)}"), (62, " ".join(items[2][1].split()[:12]))]
    rows += [(70 + k, f"{text(50)} you stup1d idiot {text(5)}" if k % 2 else text(40)) for k in range(40)]
    rows += [(45, None), (55, base), (10**12, text(5))]
    rows.append(rows[0])
    rows.append(rows[12])
    out = tmp_path_factory.mktemp("edge")
    wide = spark.createDataFrame([(*r, "s", 1, "c", True, 7) for r in rows], "doc_id long, text string, anchor string, n int, component string, hot boolean, row int")
    wide.repartition(5).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(d, 1, int("idiot" in (t or ""))) for d, t in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    urls = [None, "", "nothing", "http://EXAMPLE.com/en/7x?y#z", "https://a.b.Example.COM/en/1", "ftp://x.net/de/8", "http://example.net/de/88/", "http://q.org?/es/", "http://q.org/es/1://", "://", "http://cheap-pills.info/buy", "x" * 3000 + "://host.org/" + "p" * 5000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{out}/pages.parquet")
    return str(out)


@pytest.fixture(scope="module")
def small(spark, edge):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{edge}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def both(spark, docs, edge, small):
    return [(DATA, docs), (edge, small)]


def test_line_dedup(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        want = brute.line_dedup(own)
        got = queries.op1_line_dedup(spark, folder).collect()
        assert len(got) == len(own)
        for r in got:
            n, dropped, kept = want[r.doc_id]
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
    assert any(r.n_dropped for r in got)


def test_line_dedup_in_slices(spark, edge, monkeypatch):
    """Beyond the limit of what is broadcast the filters still let through the same lines, slice by slice."""
    for folder in (DATA, edge):
        df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
        whole = line_dedup.suspects(df)
        count, lines = whole.count(), {tuple(r) for r in line_dedup.repeated_lines(df).collect()}
        every = sum(len([d for d in {*line_dedup.digests(t.encode() if t else None, 40)} if d]) for _, t in df.collect())
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 1)
        assert line_dedup.suspects(df).count() == count < every
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(common, "HOT_KEYS", 1 << 30)
        assert {tuple(r) for r in line_dedup.repeated_lines(df).collect()} == lines != set()
        monkeypatch.undo()


def test_sparse_attachment(spark):
    docs = spark.createDataFrame([(k % 7 or None, f"t{k}") for k in range(20)], "doc_id long, text string")
    extra = spark.createDataFrame([(1, [1, 2]), (3, [5])], "id long, found array<int>")
    want = sorted((d or 0, t, {1: [1, 2], 3: [5]}.get(d)) for d, t in docs.collect())
    for size, ids in ((0, 9), (1 << 40, 9), (1 << 40, 1)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "BROADCAST_IDS", ids)
            got = common.attached(docs, extra, "id", size)
            assert got.columns == ["doc_id", "text", "found"] and sorted((d or 0, t, f) for d, t, f in got.collect()) == want


def test_other_columns_keep_their_names(spark):
    rows = [(k, EDGE, "a", "b", "c") for k in range(6)]
    names = ["doc_id", "text", "__wl_out", "__wl_drop", "__wl_id"]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, names))
    assert got.columns == [*names, "__wl_out_"] and sorted(r.text for r in got.collect()) == [""] * 5 + [EDGE]


def test_near_dup(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        want = brute.components(own, 4)
        got = queries.op2_near_dup(spark, folder).collect()
        assert len(got) == len(own)
        for r in got:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize(("few", "block"), [(near_dup.FEW, near_dup.BLOCK), (1, 4)])
def test_chains_join(spark, monkeypatch, few, block):
    """Each text is near the next one only, so that no pivot is near all of its component; with any size of blocks."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120])) for k in range(90)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(df, words=4).collect()} == want
    assert len({c for _, c in want.values()}) < 90


def test_pairs_of_blocks():
    """Blocks give out each pair of two components that is at the threshold, once, and no pair of one component."""
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.union1d(base[: 300 - 9 * k], rng.integers(0, 1 << 64, 6 * k, dtype=np.uint64)) for k in range(24)]
    own = {"rep": np.arange(24), "n": np.array([len(x) for x in sets]), "component": np.arange(24) // 2, "rank": np.ones(24, dtype=np.int64), "registers": np.stack([near_dup.registers(x) for x in sets])}
    near = {(i, j) for j in range(24) for i in range(j) if i // 2 != j // 2 and near_dup.linked(sets[i].tobytes(), sets[j].tobytes(), 80)}
    got = lambda x, y: [(min(p), max(p)) for a, b in near_dup.block_pairs(x, y, 80) for p in zip(a.tolist(), b.tolist(), strict=True)]
    part = lambda rows: {c: v[rows] for c, v in own.items()}
    whole = got(own, None)
    even, odd = part(slice(0, 24, 2)), part(slice(1, 24, 2))
    dealt = got(even, None) + got(odd, None) + got(even, odd)
    assert near and near <= set(whole) and len(set(whole)) == len(whole) and sorted(dealt) == sorted(whole)
    assert all(i // 2 != j // 2 for i, j in whole) and len(whole) < 24 * 23 // 2


def test_registers_merge_and_estimate():
    rng = np.random.Generator(np.random.PCG64(1))
    for j in (0.5, 0.8, 0.95):
        n = 4000
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
        a, b = pool[:n], pool[n - common :]
        ra, rb = near_dup.registers(a), near_dup.registers(b)
        assert (near_dup.merged(ra, rb) == near_dup.registers(np.union1d(a, b))).all()
        assert abs((ra == rb).mean() - j) < 0.15
        ok = near_dup.possible(ra[None], rb[None], np.array([n]), np.array([n]))[0]
        assert ok == (j >= 0.8)


def test_packing(spark, docs, edge, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for folder, own in both(spark, docs, edge, small):
        got = queries.op3_packing(spark, folder).collect()
        want = Counter()
        for doc, text in own:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = ids[at : at + 4096]
                want[doc, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(by) <= 1.02 * math.ceil(sum(r.length for r in got) / 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25), st.integers(2, 8), st.sampled_from(["dot", "norm"]))
def test_vector_capacities(counts, documents, rule):
    attention = 60 * 60 + 50
    found = packing.patterns(counts, 100, documents, attention, rule=rule)
    used = Counter()
    for times, own in found:
        assert sum(x * n for x, n in own) <= 100 and sum(n for _, n in own) <= documents and sum(x * x * n for x, n in own) <= attention
        for x, n in own:
            used[x] += n * times
    assert used == Counter(counts)


def test_packing_with_binding_capacities(spark):
    """The document and attention capacities through pack(), where each of them, and not the tokens alone, closes sequences."""
    df = spark.createDataFrame([(k, "word " * (1 + k % 150)) for k in range(600)], "doc_id long, text string")
    counts = {}
    for documents, attention in ((None, None), (4, None), (None, 40_000), (4, 40_000)):
        found = defaultdict(list)
        for r in packing.pack(df, tokens=512, documents=documents, attention=attention).collect():
            found[r.sequence_id].append(r.length)
        assert sum(map(len, found.values())) == 600
        for own in found.values():
            assert sum(own) <= 512 and len(own) <= (documents or 512) and sum(x * x for x in own) <= (attention or 512 * 512)
        counts[documents, attention] = len(found)
    assert counts[None, None] < min(counts[4, None], counts[None, 40_000]) and counts[4, 40_000] >= max(counts[4, None], counts[None, 40_000])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_ogg_round_trip(data, packet):
    samples = ogg.padded(data)
    media = ogg.encode(samples, packet=packet)
    back, times = ogg.decode(media)
    assert back == samples and times[-1] == len(samples) / ogg.RATE
    for size in (254, 255, 256, 510):
        assert ogg.decode(ogg.encode(samples, packet=size))[0] == samples
    at = len(media) // 2
    with pytest.raises(ogg.Corrupt):
        ogg.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ogg.Corrupt):
        ogg.decode(media[:-1])


def test_ogg_pages():
    assert [ogg.checksum(x) for x in (b"", b"a", b"OggS\0\2" * 50)] == [brute.ogg_crc(x) for x in (b"", b"a", b"OggS\0\2" * 50)]
    long = bytes(200_000)
    pages = ogg.stream_pages(9, [(b"head", 0), (long, 7)])
    assert len(pages) == 5 and pages[2][5] & ogg.CONTINUED
    assert ogg.demultiplex(b"".join(pages))[9] == [(b"head", 0), (long, 7)]
    with pytest.raises(ogg.Corrupt):
        ogg.demultiplex(b"".join(pages[:2] + pages[3:]))


def test_ogg_times_from_granules():
    sizes = (8000, 70_000, 4000, 70_000, 4000)
    ends = [sum(sizes[: k + 1]) for k in range(5)]

    def media(own, used=sizes):
        notes = [(ogg.NOTE_MAGIC, 0), *((n.to_bytes(4, "little"), 0) for n in used)]
        audio = [(ogg.MAGIC + (8000).to_bytes(4, "little") + b"\1\10", 0), *((bytes([k]) * n, g) for k, (n, g) in enumerate(zip(used, own, strict=True)))]
        return b"".join(ogg.stream_pages(ogg.AUDIO, audio) + ogg.stream_pages(ogg.NOTES, notes))

    whole, times = ogg.decode(media(ends))
    assert (len(whole), times) == (156_000, [e / 8000 for e in ends])
    late = [e + 16_000 for e in ends]
    assert ogg.decode(media(late)) == (whole, [e / 8000 for e in late])
    assert ogg.decode(media([*ends[:4], ends[4] - 1000])) == (whole[:-1000], [*times[:4], (ends[4] - 1000) / 8000])
    assert ogg.decode(media([*late[:4], late[4] - 1000])) == (whole[:-1000], [*(e / 8000 for e in late[:4]), (late[4] - 1000) / 8000])
    assert ogg.decode(media([900], [1000]))[1] == [900 / 8000] and ogg.decode(media([1100], [1000]))[1] == [1100 / 8000]
    for wrong in ([*ends[:4], ends[4] + 1], [*ends[:4], ends[0]], [ends[0], ends[1] - 1, ends[2] - 1, *ends[3:]], [-1] * 5):
        with pytest.raises(ogg.Corrupt):
            ogg.decode(media(wrong))


def test_ogg_query(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        got, texts = queries.op4_ogg(spark, folder).collect(), dict(own)
        assert len(got) == len(own)
        by = defaultdict(set)
        for r in got:
            b = (texts[r.doc_id] or "").encode()
            p = ogg.padded(b)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            by[b].add((r.media_sha256, r.media_bytes, r.feature))
        assert all(len(x) == 1 for x in by.values())


def test_media_that_cannot_be_read(spark):
    good = ogg.encode(ogg.padded(b"abc"))
    other = b"".join(ogg.stream_pages(7, [(b"x", 0)]))
    silent = b"".join(ogg.stream_pages(ogg.AUDIO, [(ogg.MAGIC + bytes(6), 0)]) + ogg.stream_pages(ogg.NOTES, [(ogg.NOTE_MAGIC, 0)]))
    short = b"".join(ogg.stream_pages(ogg.AUDIO, [(ogg.MAGIC, 0)]) + ogg.stream_pages(ogg.NOTES, [(ogg.NOTE_MAGIC, 0)]))
    media = [good, None, b"", b"OggS", good[:-1], good[:40] + b"!" + good[41:], other, silent, short]
    got = rows_of(ogg.described(spark.createDataFrame([(k, 3, m) for k, m in enumerate(media)], ogg.STORED)))
    assert got[0].error is None and got[0].payload_bytes == 64
    for k, m in enumerate(media[1:], 1):
        assert got[k].error and got[k].feature is None and got[k].payload_sha256 is None
        assert got[k].media_bytes == (None if m is None else len(m))


def test_ogg_features(spark, small, edge):
    """The feature column against sums over single samples."""
    texts = dict(small)
    for r in queries.op4_ogg(spark, edge).collect():
        x = [c - 128 for c in ogg.padded((texts[r.doc_id] or "").encode())]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        packets = -(-len(x) // ogg.PACKET)
        want = f"packets={packets};seconds={len(x) / 8000:.6f};mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};peak={max(map(abs, x))};crossings={crossings}"
        assert r.feature == want and r.error is None


def test_base_scores(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        want = brute.unigram(own)
        for r in queries.op5_ppm(spark, folder).collect():
            held, n, known, total, base = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_rare_words_meet_their_counts(spark, edge, small):
    """With few, some and all words broadcast, long ones among them."""
    df = spark.read.parquet(f"{edge}/documents.parquet")
    want = brute.unigram(small)
    for hot in (0, 5, 300):
        for r in ppm.score(df, order=1, hot=hot).collect():
            assert (r.n_known, r.base_score) == (want[r.doc_id][2], pytest.approx(want[r.doc_id][4], rel=1e-9))
    words = spark.createDataFrame([(b"w%d" % k, 1 + k % 90) for k in range(900)] + [(b"x" * 500, 80)], ppm.WORD)
    found = ppm.frequent_words(words, 200)
    least = min(n for _, n in found)
    assert 100 <= len(found) <= 200 and (ppm.word_key(b"x" * 500), 80) in found
    assert len(found) == words.where(f"count >= {least}").count()


def test_ppm_is_right(spark, docs):
    train, rest = [(d, t) for d, t in docs[:40]], docs[40:50] + [(-1, None), (-2, "日本語 \0\0 zzz"), (-3, "the")]
    for order in (0, 2, 4):
        model = ppm.train(spark.createDataFrame(train, "doc_id long, text string"), order)
        plain = brute.Ppm([(t or "").encode() for _, t in train], order)
        texts = [(t or "").encode()[:3000] for _, t in rest]
        assert model.text_scores(texts) == pytest.approx([plain.score(t) for t in texts], rel=1e-9)


def test_ppm_with_few_nodes_stays_a_distribution(spark, docs):
    model = ppm.train(spark.createDataFrame(docs[:40], "doc_id long, text string"), 3, nodes=500)
    assert max(map(len, model.codes)) <= 500
    for context in (b"the", b"zzz", b"\0\0\0", b" of"):
        code = np.array([int.from_bytes(context, "big") << 9 | s for s in range(257)], dtype=np.int64)
        assert (10 ** model.scores(code)).sum() == pytest.approx(1)


def test_ppm_scores_of_the_query(spark, docs, edge, small, monkeypatch):
    """Whole texts through the query, the trie in one group and in many."""
    for folder, own in both(spark, docs, edge, small):
        learnt = [t for d, t in own if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
        plain = brute.Ppm([(t or "").encode() for t in learnt], ppm.ORDER)
        want = sorted((d, round(plain.score((t or "").encode()), 6)) for d, t in own)
        for group in (ppm.GROUP, 1000):
            monkeypatch.setattr(ppm, "GROUP", group)
            got = sorted((r.doc_id, r.score) for r in queries.op5_ppm(spark, folder).collect())
            assert [d for d, _ in got] == [d for d, _ in want]
            assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9, abs=1e-6)


def test_ppm_keeps_all_codes(spark):
    """Over two million codes of order 4, most learnt once: each still meets its own count."""
    rng = random.Random(7)
    texts = [bytes(rng.choices(range(48, 112), k=550_000)) for _ in range(4)]
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5 != 1][:4]
    code, starts = ppm.codes(texts)
    own, at, n = np.unique(code, return_inverse=True, return_counts=True)
    assert len(own) > 2_000_000
    _, context, kinds = np.unique(own >> 9, return_inverse=True, return_counts=True)
    total = np.bincount(context, weights=n)
    want = np.add.reduceat((np.log10(n) - np.log10(total + kinds)[context])[at], starts)
    got = rows_of(ppm.score(spark.createDataFrame(list(zip(ids, (t.decode() for t in texts), strict=True)), "doc_id long, text string")))
    assert [got[d].score for d in ids] == pytest.approx(list(want), rel=1e-9)


def test_ppm_without_training(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    model = ppm.train(df.where("false"))
    assert model.text_scores([b"ab"])[0] == pytest.approx(3 * math.log10(1 / 257))


def test_toxicity(spark):
    folder = DATA.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.op6_toxicity(spark, folder).collect() if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " trash ": 4.0, " lowei": 3.0}, fit=(-2.0, 1.0, 1.0))
    assert toxicity.folded("ІD1ОT!") == " idiot "
    for text in ("you 1d10t", "you ІDIОT, yes", "id​iot", "ｉｄｉｏｔ"):
        assert lexicon.features(text)[0] == 5, text
    assert lexicon.features("put it in the trash can") == (0, 0)
    assert lexicon.features("trash! the trash can")[0] == 4
    assert lexicon.features("loweischaft idiotic lowei")[0] == 6
    assert lexicon.features("an idiot " + "x " * 1000)[1] < lexicon.features("an idiot")[1]


def test_toxicity_equals_plain(spark, edge, small):
    """Weights, fit and scores of whole tables against loops over words and patterns."""
    larger = DATA.replace("0.001", "0.01")
    for folder, own in ((larger, [(r.doc_id, r.text) for r in spark.read.parquet(f"{larger}/documents.parquet").collect()]), (edge, small)):
        labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
        toxic = {}
        for d, t in labels:
            if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1:
                toxic[d] = max(t, toxic.get(d, 0))
        learnt = [(t, toxic[d]) for d, t in own if d in toxic]
        want = brute.lexicon(learnt, toxicity)
        table = spark.read.parquet(f"{folder}/documents.parquet")
        made = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
        assert made.weights == pytest.approx(want) != {}
        got = sorted((r.doc_id, r.score) for r in queries.op6_toxicity(spark, folder).collect())
        scores = sorted((d, brute.toxicity(t or "", want, made.fit, toxicity)) for d, t in own)
        assert [d for d, _ in got] == [d for d, _ in scores]
        assert [x for _, x in got] == pytest.approx([x for _, x in scores], abs=1e-9)


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(spark.read.parquet(f"{edge}/documents.parquet"), none).collect()} == {0.0}


def test_decontaminate(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        want = brute.hits(own, items)
        got = queries.op7_decontaminate(spark, folder).collect()
        assert len(got) == len(own)
        for r in got:
            n, hit, names = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        table = spark.read.parquet(f"{folder}/benchmark.parquet")
        made = list(decontaminate.automata(table, limit=4000))
        assert len(made) > 2 and all(len(a.names) == 1 or a.bytes() <= 8000 for a in made)
        for r in decontaminate.scan(spark.read.parquet(f"{folder}/documents.parquet"), table, "hits", limit=4000).collect():
            spans = r.hits.spans
            assert [k for a, b in zip(spans[::2], spans[1::2], strict=True) for k in range(a, b)] == want[r.doc_id][1]
            assert r.hits.n_words == want[r.doc_id][0] and sorted(r.hits["items"]) == want[r.doc_id][2]


def test_each_block_is_a_stage_of_its_own(spark, edge):
    table = spark.read.parquet(f"{edge}/benchmark.parquet")
    assert len(list(decontaminate.automata(table, limit=2000))) >= 5
    plan = decontaminate.scan(spark.read.parquet(f"{edge}/documents.parquet"), table, "hits", limit=2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_items_without_a_name(spark):
    docs = spark.createDataFrame([(1, "w x y z " + " ".join(f"u{k}" for k in range(20)))], "doc_id long, text string")
    items = spark.createDataFrame([(None, "x y"), (None, "y z"), (4, "z u0")], "item_id long, text string")
    r = decontaminate.verdicts(docs, items).first()
    assert (r.n_hit, r["items"], r.contaminated) == (4, ["4", None], True)
    r = decontaminate.verdicts(docs, items, limit=1).first()
    assert (r.n_hit, r["items"], r.contaminated) == (4, ["4", None], True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton(items, doc, window):
    own = [(str(k), [w.encode() for w in x]) for k, x in enumerate(items)]
    spans, found = decontaminate.Automaton(own, window).ranges([w.encode() for w in doc])
    want = brute.hits([(0, " ".join(doc))], [(str(k), " ".join(x)) for k, x in enumerate(items)], window)[0]
    assert [k for a, b in spans for k in range(a, b)] == want[1] and sorted(found) == want[2]


def test_substrings(spark, docs, edge, small):
    for folder, own in both(spark, docs, edge, small):
        want = brute.substrings([*{(d, t) for d, t in own}])
        got = queries.op8_suffix_dedup(spark, folder).collect()
        assert len(got) == len(own)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_substrings_of_hot_anchors(spark):
    rng = random.Random(3)
    common = "".join(rng.choices("abcd", k=110))
    rows = [(k, "".join(rng.choices("abcd", k=rng.randrange(80))) + common[rng.randrange(9) :] + "".join(rng.choices("ab", k=60))) for k in range(60)]
    rows += [(100, "a" * 700), (101, "b" + "a" * 300), (102, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.substrings(rows)
    for hot in (3, 10**6):
        got = suffix_dedup.dedup_substrings(df, hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=5, max_size=12), min_size=1, max_size=4), max_size=9))
def test_family(batches):
    family, seen = suffix_dedup.Family(5), set()
    for runs in batches:
        got, want = family.add([r.encode() for r in runs]), []
        for r in runs:
            for i in range(len(r) - 4):
                want.append(r[i : i + 5] in seen)
                seen.add(r[i : i + 5])
        assert got.tolist() == want
    assert len(family.levels) <= 2 + math.log2(1 + sum(len(x.array) for x in family.levels))
    for level in family.levels:
        own = [level.data[i : i + 5].tobytes() for i in level.array]
        assert own == sorted(set(own))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=100, max_size=160), min_size=1, max_size=6), st.integers(0, 60), st.sampled_from([8, 9, 37, 64, 100]))
def test_long_windows_in_the_family(runs, shift, length):
    runs = [*runs, (runs[0] * 2)[shift:], runs[-1]]
    family, seen = suffix_dedup.Family(length), set()
    for r in runs:
        want = []
        for i in range(len(r) - length + 1):
            want.append(r[i : i + length] in seen)
            seen.add(r[i : i + length])
        if len(r) >= length:
            assert family.add([r]).tolist() == want


def test_substrings_of_many_parts(spark, monkeypatch, docs):
    """Parts of a text or two, so that nearly all goes through the partitions' families, hot anchors window by window."""
    own = docs[:60]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(30)
    want = brute.substrings(own)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 1)
    for hot in (1, 10**6):
        got = suffix_dedup.dedup_substrings(df, hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_texts_that_share_an_id(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=300))
    rows = [(1, text), (1, text), (1, text + "tail"), (2, text)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (1, 304, 0), (2, 300, 300)]


def test_urls(spark, edge):
    """Against a version that shares only the labelled table's weights and the rules."""
    for folder in (DATA, edge):
        rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
        got = rows_of(url_filter.judge(spark.read.parquet(f"{folder}/pages.parquet")), "page_id")
        weights, bias = url_filter.weights()
        for r in rows:
            host, path, rule, verdict, score = brute.url(r.url, url_filter.RULES, weights, bias)
            g = got[r.page_id]
            assert (g.host, g.path, g.rule, g.verdict) == (host, path, rule, verdict)
            assert g.score == pytest.approx(score)


def test_url_rules_by_hand(spark):
    cases = [
        ("http://EXAMPLE.com/en/1", "example.com", "/en/1", "com/en/", "block"),
        ("http://a.example.com/en/77?x#y", "a.example.com", "/en/77", "example.com/en/7", "allow"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("http://org/es/", "org", "/es/", "org/es/", "block"),
        ("http://q.org?a/es/", "q.org", "", None, None),
    ]
    got = rows_of(url_filter.judge(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")), "page_id")
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and verdict in (None, got[k].verdict)


def test_url_model_judges_hosts_it_has_not_seen():
    right = 0
    for fold in range(5):
        weights, bias = url_filter.trained([r for k, r in enumerate(url_filter.LABELLED) if k % 5 != fold])
        for url, label in url_filter.LABELLED[fold::5]:
            right += (brute.url(url, [], weights, bias)[4] >= 0.5) == bool(label)
    assert right >= 0.8 * len(url_filter.LABELLED)
    assert len({url.split("/")[2] for url, _ in url_filter.LABELLED}) == len(url_filter.LABELLED)


def test_sharding(spark, docs, edge, small, tmp_path):
    for folder, own in both(spark, docs, edge, small):
        for size in (20_000, sharding.BUCKET_BYTES):
            done = sharding.shard(spark.read.parquet(f"{folder}/documents.parquet"), bucket_bytes=size).collect()
            assert Counter((r.doc_id, r.text) for r in done) == Counter(own)
            slots = defaultdict(list)
            for r in done:
                slots[r["__wl_shard"]].append(r["__wl_slot"])
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
            counts = [len(slots[k]) for k in range(40)]
            assert max(counts) - min(counts) <= 1
    for folder, own in both(spark, docs, edge, small):
        texts, sizes = defaultdict(list), Counter()
        for d, t in own:
            texts[d].append((t or "").encode())
        got = queries.op10_sharding(spark, folder).collect()
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in own)
        for r in got:
            b = texts[r.doc_id][0]
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
            sizes[r.shard] += 1
            assert 0 <= r.shard < 40 and 0 <= r.slot < len(own)
        assert len({(r.shard, r.slot) for r in got}) == len(own)
        assert all(n in (len(own) // 40, -(-len(own) // 40)) for n in [sizes[k] for k in range(40)])
    sharding.write(spark.read.parquet(f"{DATA}/documents.parquet"), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(docs)


def test_shards_do_not_follow_the_files(spark, tmp_path, small):
    """The same rows in other files, sizes and orders get the same shards; one doc_id, or rows equal in all, fill no bucket."""
    rows = small + [(None, f"text {k}") for k in range(50)] + [(7, "same row")] * 400 + [(8, f"text {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for k, (parts, codec) in enumerate(((1, "none"), (7, "zstd"), (3, "snappy"))):
        df.orderBy(F.rand(k)).repartition(parts).write.option("compression", codec).parquet(f"{tmp_path}/{k}")
        done = sharding.shard(spark.read.parquet(f"{tmp_path}/{k}"), shards=5, bucket_bytes=8000, copies=20).collect()
        found.append(sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "", r["__wl_shard"], r["__wl_slot"]) for r in done))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    places = sorted(s * 5 + h for _, _, h, s in found[0])
    assert places == list(range(len(rows)))
    same = [s * 5 + h for d, t, h, s in found[0] if t == "same row"]
    assert max(same) - min(same) > 420


def test_queries_on_edge_and_empty_tables(spark, edge, tmp_path):
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{edge}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    n = spark.read.parquet(f"{edge}/documents.parquet").count()
    pages = spark.read.parquet(f"{edge}/pages.parquet").count()
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
        found = query(spark, edge).count()
        assert found == (pages if "url" in name else n) or name in ("op3_packing", "pipeline"), name


def test_null_ids(spark, tmp_path):
    rows = [(None, EDGE), (None, "x" * 300), (1, "x" * 300), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(None, "a b"), (1, "x" * 300)], "item_id long, text string")
    found = [line_dedup.dedup_lines(df), near_dup.components(df), packing.pack(df), ogg.described(ogg.store(df)), ppm.score(df), toxicity.scores(df, labels), decontaminate.verdicts(df, items), suffix_dedup.dedup_substrings(df), sharding.shard(df)]
    assert [x.count() for x in found] == [4] * 9
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = lambda stage: Counter((r.doc_id, r.text) for r in stage(spark, df, str(tmp_path)).collect())
    assert left(toxicity.stage) == left(line_dedup.stage) == left(near_dup.stage) == Counter(rows)
    assert left(decontaminate.stage) == Counter([r for r in rows if r[1] != "x" * 300])
    assert packing.stage(spark, df, str(tmp_path)).where("doc_id is null").count() == 3


def test_pipeline(spark, edge, docs, small):
    """The stages one by one against the plain versions; toxicity is taken as it decides."""
    import corpus_pipeline

    for folder, own in ((DATA, docs), (edge, small)):
        df = spark.read.parquet(f"{folder}/documents.parquet")
        at, columns = df, df.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
            at = line_dedup.written(stage(spark, at, folder), "test")
            assert at.columns == columns
            after = Counter((r.doc_id, r.text) for r in at.select("doc_id", "text").collect())
            if name == "toxicity":
                assert not after - Counter(before)
                continue
            if name == "line_dedup":
                kept = brute.line_dedup(before)
                want = Counter((d, t and kept[d][2]) for d, t in before)
            elif name == "minhash_near_dedup":
                root = brute.components(before, 5)
                want = Counter((d, t) for d, t in before if root[d][1] == d)
            else:
                hit = brute.hits(before, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
                want = Counter()
                for d, t in before:
                    n, at_words, _ = hit[d]
                    if at_words and 20 * len(at_words) >= n:
                        continue
                    want[d, t if not at_words else None] += 1
                got = Counter()
                for (d, t), k in after.items():
                    at_words = set(hit[d][1])
                    if at_words:
                        old = dict(before)[d]
                        assert brute.item_words(t) == [w for i, w in enumerate(brute.item_words(old)) if i not in at_words]
                        t = None
                    got[d, t] += k
                after = got
            assert after == want, name
        packed = corpus_pipeline.run(spark, folder)
        assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").collect()}
    assert (at.where(F.col("text").contains("idiot")).count()) == 0
