"""Operators on texts against brute force on small fixtures with every odd case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, language_id, near_dedup, packing, pii, records, substring_dedup, toxicity
from tessella.runtime import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 int, n int, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{rng.integers(vocabulary)}é" if i % 7 == 0 else f"w{rng.integers(vocabulary)}" for i in range(n)]


def texts():
    base, passage = words(120, 1), words(60, 2)
    near = base.copy()
    near[50] = "changed"
    out = [
        " ".join(base), " ".join(base).upper(), " ".join(near), " \n".join(base), "", None, " \t\n", "one", "one two three four", "one two three four",
        " ".join(words(40, 3) + passage + words(30, 4)), " ".join(words(20, 5) + passage + words(90, 6)), " ".join(["again"] * 100), " ".join(words(10, 7) * 9),
        " ".join(words(20_000, 8, 50_000)), "x" * 20_000, "mail a.b@c.example.com or +1 (578) 555-8087, 10.0.0.255, 4111 1111 1111 1111", "null\x00 byte\x1cand \x85 odd\xa0spaces ​ 😀👩‍👩‍👧",
        "  two  spaces \n\n\n and lines\n", "<|endoftext|> is text", "ǅ İ ß é́ ﬁ",
    ]
    return [(i * 3, t, "en", "s", 1, 7, 8, "z") for i, t in enumerate(out)] + [(0, out[0], "en", "s", 1, 7, 8, "z"), (None, out[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark, docs, none):
    rows = texts()
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    want = collections.Counter()
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        comp = min(ids) if sets[i] and ids else r[0]
        want[(r[0], len(sets[i]), comp, r[0] == comp)] += 1
    got = collections.Counter(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_dense_group(spark):
    """Hundreds of variants of one text, linked or not, give the exact components."""
    rng = np.random.default_rng(5)
    base, rows = words(80, 9, 4000), []
    for i in range(150):
        w = base.copy()
        for k in rng.integers(80, size=rng.integers(0, 5)):
            w[k] = f"new{rng.integers(30)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    label = list(range(150))
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(label))


def test_merging_lists_counts_collisions():
    """Prefix merging with skips finds what counting every pair's coordinates finds."""
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 3, (60, near_dedup.COORDS)).astype(np.int32)
    sigs[20:40] = np.where(rng.random((20, near_dedup.COORDS)) < 0.75, sigs[0], sigs[20:40])
    lists, everyone = near_dedup.PostingLists(sigs), np.ones(60, dtype=bool)
    for least in (20, 34, 64, 96):
        for at in range(60):
            assert lists.matches(at, everyone, least).tolist() == np.flatnonzero((sigs == sigs[at]).sum(axis=1) >= least).tolist()


def test_blocks_of_a_large_cluster():
    """Pairs of blocks and one block agree."""
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([np.arange(60, dtype=np.uint64), rng.integers(60, 90, 12).astype(np.uint64)])) for _ in range(90)]
    nodes = np.arange(90)
    a, b = near_dedup.confirmed_forest(nodes, sets, 85)
    pairs = [(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    x, y = near_dedup.forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert sorted(zip(a, b)) == sorted(zip(x, y))


def test_fingerprint_index_is_incremental(spark):
    """A batch returns what it shares with the history and with itself, and nothing twice."""
    index = substring_dedup.FingerprintIndex(spark, fan_in=2)

    def add(*rows):
        return {(r.text, r.fp) for r in index.add(spark.createDataFrame(rows, "text long, fps array<long>")).collect()}

    assert add((1, [10, 11, 12]), (2, [12, 13]), (3, [])) == {(1, 12), (2, 12)}
    assert add((4, [20, 20]), (5, [10])) == {(4, 20), (1, 10), (5, 10)}
    assert add((6, [10, 30])) == {(6, 10)}  # texts 1 and 5 were returned with it before
    assert len(index.runs) == 3
    assert add((7, [11, 12, 20, 40])) == {(1, 11), (7, 11), (7, 12), (7, 20)}
    assert len(index.runs) == 2 and spark.table(list(index.runs)[0]).count() == 6  # compacted: a row for each fingerprint
    assert add((8, [40, 13, 50])) == {(7, 40), (8, 40), (2, 13), (8, 13)}
    first, second, *_ = index.runs
    plan = spark.table(first).join(spark.table(second).hint("merge"), "fp", "left_semi")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    index.close()


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup(spark, docs, none, parts):
    rows = texts()
    count = collections.Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    batches = [docs] if parts == 1 else docs.randomSplit([1.0] * parts, seed=4)
    got = substring_dedup.substring_dedup(batches, deal=1 if parts > 1 else 4).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert substring_dedup.substring_dedup([none]).count() == 0


def test_byte_bpe(spark, docs, none):
    path, pattern = public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN
    own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = collections.Counter()
    for r in texts():
        ids = own.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in byte_bpe.round_trip_digests(docs, path, pattern).collect()) == want
    assert byte_bpe.round_trip_digests(none, path, pattern).count() == 0


def test_stream_decoder_holds_back_unfinished_characters():
    decoder = byte_bpe.StreamDecoder({b: bytes([b]) for b in range(256)})
    assert [decoder.feed(b) for b in "é😀".encode()] == ["", "é", "", "", "", "😀"]
    for data in (b"\xff", b"a\xe2\x82", b"\xc3(", b"\xed\xa0\x80", b"\xf0\x9f\x98x", b"\xe2\x82\xac\xe2"):
        got = [decoder.feed(b) for b in data] + [decoder.finish()]
        assert "".join(got).replace("�", "") == data.decode(errors="ignore")


def test_transducer_equals_plain_merging():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    machine = byte_bpe.Transducer(ranks, limit=50)  # emptied all the time
    rng = np.random.default_rng(2)
    for _ in range(400):
        data = bytes(rng.choice(list(b"aeinrst \xc3\xa9\xe4"), size=rng.integers(1, 14)).tolist())
        assert machine.encode(data) == byte_bpe.merge(data, ranks)


def test_packing(spark, docs, none):
    path, pattern = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.PATTERN
    rows = packing.best_fit_pack(docs, path, pattern).collect()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    want = collections.Counter()
    for r in texts():
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [0]
        edges = packing.cut(len(ids))
        assert edges[0] == 0 and edges[-1] == len(ids) and all(b - a == 2048 for a, b in zip(edges[1:], edges[2:]))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.best_fit_pack(none, path, pattern).count() == 0


def packed(spark, lengths, parts=7):
    """The bins of a table of these lengths, checked for gaps."""
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    out = packing.pack_table(spark.createDataFrame(rows, packing.PIECES).repartition(parts)).collect()
    assert sorted((r.doc_id, r.length) for r in out) == [(i, n) for i, _, _, n, _ in rows]
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing_in_several_tasks(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 4000)
    assert packed(spark, lengths) <= 1.02 * -(-int(lengths.sum()) // 2048)
    assert packed(spark, [1100] * 3000) == 3000  # every bin stays underfull
    assert packed(spark, [1100, 948] * 500 + [2048] * 300) == 800


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return collections.Counter(free)


def test_best_fit_of_classes_equals_best_fit_of_pieces():
    rng = np.random.default_rng(4)
    for high, n in ((30, 300), (90, 200), (100, 120)):
        lengths = rng.integers(1, high, n).tolist()
        bins = packing.best_fit(collections.Counter(lengths), 100)
        free = collections.Counter()
        for pattern, m in bins.items():
            free[100 - packing.fill_of(pattern)] += m
        assert free == plain_best_fit(lengths, 100)


def test_local_search_reaches_the_bound():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 700, 3000).tolist()
    first = packing.best_fit(collections.Counter(lengths), 2048)
    better = packing.local_search(first, 2048)
    held = collections.Counter()
    for pattern, m in better.items():
        assert packing.fill_of(pattern) <= 2048
        for length, n in pattern:
            held[length] += n * m
    assert held == collections.Counter(lengths) and sum(better.values()) <= sum(first.values())
    # arrangements that best fit can't better, but an exchange can, for many bins at once
    worse = collections.Counter({((6, 1),): 5, ((5, 1), (4, 1)): 5, ((5, 1), (3, 1)): 5, ((7, 1),): 5})
    assert sum(packing.local_search(worse, 10).values()) == 15


def test_records(spark, docs, none):
    path = public_tokenizers.path(records.VOCABULARY)
    manifest = records.write_records(docs, path, scratch_path(spark, "t"))
    rows = records.read_records(spark, manifest).orderBy("start").collect()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [1] for i, (_, t, *_) in enumerate(texts())}
    want = collections.Counter((r[0], len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, r in enumerate(texts()))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at, last = 0, -1
    for r in rows:
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    empty = records.write_records(none, path, scratch_path(spark, "t"))
    assert records.read_records(spark, empty).count() == 0


def test_records_are_framed_checked_and_random_access(tmp_path):
    path = f"file://{tmp_path}/x.rec"
    writer = records.RecordWriter(path)
    for i in range(50):
        writer.write(records.pack_record(i or None, np.arange(i, dtype="<u2").tobytes()))
    writer.close()
    reader = records.RecordReader(path)
    assert [records.unpack_record(reader[i])[0] for i in (49, 0, 7)] == [49, None, 7]
    assert [len(records.unpack_record(p)[1]) for p in reader] == list(range(50))
    data = bytearray((tmp_path / "x.rec").read_bytes())
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data), 0)


def test_pii(spark, docs, none):
    patterns = [
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def digits(s):
        return re.sub("[^0-9]", "", s)

    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]

    def brute(text):
        return sorted(((m.start(), m.end(), k) for k, p in enumerate(patterns) for m in p.finditer(text) if ok[k](m[0])), key=lambda s: (s[0], s[2]))

    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789..  --++()@@abZ_%é:\n"), size=rng.integers(0, 50)))
        assert pii.base_spans(text) == brute(text)
    want = collections.Counter((r[0], hashlib.sha256(pii.render(brute(r[1] or "")).encode()).hexdigest()) for r in texts())
    got = pii.detect(docs).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id == 48] == [(1, 1, 1, 1)]
    assert pii.detect(none).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[48] == "mail [EMAIL] or [PHONE], [IP], [CARD]" and masked[21] == "one"


def test_long_runs_stay_linear():
    import time

    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000, "@" * 100_000, "+1 " * 60_000, "1." * 100_000):
        pii.candidates(text, pii.base_spans(text))

    def cost(n):
        loose = "call (212) 555-0187 or bob at example.com, bob (at) example.com " * n
        start = time.process_time()
        found = pii.candidates(loose, pii.base_spans(loose))
        assert len(found) == 2 * n
        return time.process_time() - start

    cost(100)
    assert cost(8000) < 12 * cost(2000) + 1
    assert time.time() - began < 120


def test_candidates_overlap_nothing():
    rng = np.random.default_rng(11)
    parts = ["a@b.com", "(212) 555-0187", "bob (at) example.com", "4111.1111.1111.1111", "10[.]0[.]0[.]1", "+1 578 555 8087", "212-555-0187", " ", " ", "x"]
    for _ in range(300):
        text = "".join(rng.choice(parts, size=rng.integers(1, 12)))
        base = pii.base_spans(text)
        loose = [s for s, _ in pii.candidates(text, base)]
        for k, (a, b, _) in enumerate(loose):
            assert not any(x < b and a < y for x, y, _ in base + loose[:k])


def test_dawid_skene_finds_the_unreliable_labeler():
    rng = np.random.default_rng(7)
    counts = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = tuple(int(np.where(rng.random() < p, 1 if y else -1, -1 if y else 1)) for p in (0.95, 0.9, 0.9, 0.85, 0.5, 0.5))
        counts[pii.pattern(0, vote)] += 1
    truth = pii.dawid_skene(counts)
    assert truth[pii.pattern(0, (1, 1, 1, 1, -1, -1))] > 0.95 and truth[pii.pattern(0, (-1, -1, -1, -1, 1, 1))] < 0.05


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(8)
    syllables = {"a": ["ka", "to", "mi"], "b": ["sch", "ung", "lich"], "c": ["ção", "nho", "eira"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(30)), k) for i, k in enumerate("abc" * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(table.where(language_id.remainder(3) != 1))
    found = language_id.identify(table, profiles, "doc_id").join(table.where(language_id.remainder(3) == 1), "doc_id").collect()
    assert found and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in language_id.identify(docs, profiles, "doc_id").collect()}
    assert odd[12].lang_pred == odd[15].lang_pred == odd[18].lang_pred == "und" and odd[12].score == 0
    assert language_id.identify(none, profiles, "doc_id").count() == 0
    assert language_id.learn(none).languages == []


def test_language_cosines_and_ties_by_brute_force(spark):
    """Scores are the cosines of bundles with centred prototypes, n-gram by n-gram."""
    own = language_id.Space()

    def bundle(text):
        chars = [0]
        for c in text.lower():
            if c.isalpha():
                chars.append(ord(c))
            elif chars[-1]:
                chars.append(0)
        chars += [0] if chars[-1] else []
        total = np.zeros(own.dimensions)
        for g in zip(chars, chars[1:], chars[2:]):
            v = np.ones(own.dimensions)
            for k, c in enumerate(g):
                v = v * np.roll(np.random.default_rng([own.seed, c]).integers(0, 2, own.dimensions, dtype=np.int8) * 2.0 - 1, len(g) - 1 - k)
            total += v
        return total

    taught = {"x": "anna banana", "y": "otto moto, loto!", "w": "otto moto, loto!"}  # w and y are the same
    table = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(taught.items())], "doc_id long, text string, lang string")
    profiles = language_id.learn(table)
    unit = {k: bundle(t) / np.linalg.norm(bundle(t)) for k, t in taught.items()}
    mean = sum(unit.values()) / 3
    for text in ("banana anna", "moto otto", "Émile 3 zola"):
        v = bundle(text)
        want = {k: float((u - mean) @ v / np.linalg.norm(u - mean) / np.linalg.norm(v)) for k, u in unit.items()}
        lang, score = profiles.predict(text)
        assert abs(score - (1 + max(want.values())) / 2) < 1e-5
        assert lang == min(k for k in want if want[k] > max(want.values()) - 1e-9)


def test_monotone_calibration_is_the_least_squares_one():
    """Against the minimax formula of the isotonic fit, on the shares before smoothing."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        x, y = rng.integers(0, 9, 30).astype(float), (rng.random(30) < 0.4).astype(float)
        w = rng.integers(1, 4, 30).astype(float)
        knots, share = toxicity._monotone(x, y, w)
        values = np.unique(x)
        mean = lambda a, b: (w * y)[(x >= a) & (x <= b)].sum() / w[(x >= a) & (x <= b)].sum()
        want = {v: max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values}
        for a, b in zip(knots[::2], knots[1::2]):
            inside = (x >= a) & (x <= b)
            assert all(abs(want[v] - mean(a, b)) < 1e-9 for v in values if a <= v <= b)
            assert np.interp(a, knots, share) >= ((w * y)[inside].sum() + 0.5) / (w[inside].sum() + 1) - 1e-12
        assert (np.diff(share) >= 0).all() and ((share > 0) & (share < 1)).all()


def test_toxicity_recall_beside_wrong_labels(spark):
    """Clean texts labelled toxic do not raise the bar for texts with toxic words."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(1500):
        words = rng.choice(["river", "stone", "meadow", "lamp", "window", "paper"], size=int(rng.integers(20, 200))).tolist()
        if i % 8 == 0:
            words[5:5] = ["grubnak"] * int(rng.integers(1, 3))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0 or i % 29 == 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(table, marks.where("doc_id % 5 <> 0"))
    out = {r.doc_id: r.predicted for r in toxicity.score(table, model, "doc_id").where("doc_id % 5 = 0").collect()}
    assert all(out[i] == int(i % 8 == 0) for i in out)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            w[10:10] = list(rng.choice(["vile", "nasty", "rotten"], 4))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(table, marks.where("doc_id % 5 <> 0"))
    out = toxicity.score(table, model, "doc_id").join(marks, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    found = toxicity.passages(table, model).where("doc_id = 0").orderBy(toxicity.F.desc("segment_score")).first()
    assert 8 <= found.start_word <= 12 and "vile" in found.passage or "nasty" in found.passage or "rotten" in found.passage
    assert toxicity.score(docs, model, "doc_id").count() == docs.count() and toxicity.score(none, model, "doc_id").count() == 0
    untaught = toxicity.learn(none.select("doc_id", "text"), marks)
    assert all(r.predicted == 0 for r in toxicity.score(docs, untaught, "doc_id").collect())


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(300):
        s = rng.integers(-4, 5, size=rng.integers(0, 12)).astype(float)

        def brute(lo, hi):
            best, at = 0.0, None
            for a in range(lo, hi):
                for b in range(a + 1, hi + 1):
                    v = s[a:b].sum()
                    if v > best or (v == best and at and b - a < at[1] - at[0]):
                        best, at = v, (a, b)
            return [] if at is None else brute(lo, at[0]) + [at] + brute(at[1], hi)

        got = toxicity.maximal_segments(s)
        assert sorted(round(v, 6) for *_, v in got) == sorted(round(float(s[a:b].sum()), 6) for a, b in brute(0, len(s)))


@pytest.mark.parametrize("which", ["byte", "byte_multi", "word"])
def test_chunks_of_odd_white_space(which):
    """Cutting at single spaces and newlines never changes the ids, whatever is beside them."""
    from tessella.llm import chunks

    rng = np.random.default_rng(12)
    alphabet = list("ab,'s1é漢 \n\n  \t\x0b\x1c\x85\xa0  　«“") + ["word", " the", "\r\n"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 14))) for _ in range(1500)] + [" ", "\n", "a b " * 5000]
    if which == "byte_multi":
        path = public_tokenizers.path(byte_bpe.VOCABULARY)
        encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={}).encode_ordinary
        cache, dtype = byte_bpe.opened(path, public_tokenizers.PATTERN).cache, "<u4"
    else:
        path = public_tokenizers.path(packing.VOCABULARY if which == "byte" else records.VOCABULARY)
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        encode = lambda t: own.encode(t, add_special_tokens=False).ids
        cache, dtype = (packing.opened(path, public_tokenizers.PATTERN), "<u4") if which == "byte" else (records.opened(path), "<u2")
    for text, blob in zip(texts, cache.encode(texts)):
        assert np.frombuffer(blob, dtype).tolist() == encode(text), repr(text)
    small = chunks.ChunkCache(cache.encode_chunks, dtype, limit=10)  # emptied all the time
    assert small.encode(texts[:200]) == cache.encode(texts[:200]) and len(small.known) <= 10
