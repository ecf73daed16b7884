"""The operators' methods against plain versions of them."""

import hashlib
import math
import time
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from streamloom.llm import chat, common, fingerprints, mixing, ngram_join, pii, quality, token_count

BASE = {  # the plain patterns
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(text):
    return regex.sub("[^0-9]", "", text)


def passes(kind, value):
    d = digits(value)
    if kind == "ip":
        return all(int(x) <= 255 for x in regex.findall("[0-9]+", value))
    if kind == "card":
        if not 12 <= len(d) <= 19:
            return False
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain_candidates(text):
    """(start, end, kind, base, votes) of one text."""
    out = []
    for patterns, base in ((BASE, True), (pii.LOOSE, False)):
        for k, kind in enumerate(pii.KINDS):
            found = list(regex.finditer(patterns[kind].replace(r"\x{A0}", "\xa0").replace(r"\x{2013}", "–"), text))
            for i, m in enumerate(found):
                if base and not passes(kind, m[0]):
                    continue
                since, until = found[i - 1].end() if i else 0, found[i + 1].start() if i + 1 < len(found) else len(text)
                before, after = text[since : m.start()][-pii.CONTEXT :], text[m.end() : until][:1]
                name = {"card": digits(m[0]), "ip": regex.sub("[^0-9]+", ".", m[0]), "phone": regex.sub("[^+0-9]", "", m[0]), "email": m[0]}[kind]
                beside = ("_" if not before and m.start() else before[-1:]) + after
                votes = (passes(kind, m[0]), regex.search(pii.LISTED[kind], name), regex.search(pii.SAID[kind], before), not regex.search("[0-9A-Za-z_]", beside), base)
                out.append((m.start(), m.end(), k, base, tuple(int(bool(v)) for v in votes)))
    return out


def plain_spans(texts):
    """The base and the added spans of each text: expectation-maximisation and the classifier over single candidates."""
    found = [plain_candidates(t) for t in texts]
    votes = np.array([c[4] for own in found for c in own], float).reshape(-1, 5)
    prior, p, q, post = 0.5, np.full(5, 0.8), np.full(5, 0.3), np.zeros(len(votes))
    for _ in range(50):
        up = np.log(prior) + np.where(votes > 0, np.log(p), np.log(1 - p)).sum(axis=1)
        down = np.log(1 - prior) + np.where(votes > 0, np.log(q), np.log(1 - q)).sum(axis=1)
        post = 1 / (1 + np.exp(down - up))
        prior = (post.sum() + 1) / (len(votes) + 2)
        p, q = (post @ votes + 4) / (post.sum() + 5), ((1 - post) @ votes + 1.5) / ((1 - post).sum() + 5)
    kinds, place, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    y, weight = np.zeros(len(kinds)), np.log1p(n)
    y[place] = post
    x, w = np.hstack([kinds, np.ones((len(kinds), 1))]), np.zeros(6)
    for _ in range(400):
        w = w - (1e-3 * w + x.T @ (weight / weight.sum() * (1 / (1 + np.exp(-x @ w)) - y)))
    out = []
    for own in found:
        base = [c for c in own if c[3]]
        more = [c for c in own if not c[3] and 1 / (1 + math.exp(-np.append(c[4], 1) @ w)) >= pii.ACCEPT and all(c[1] <= b[0] or b[1] <= c[0] for b in base)]
        out.append((sorted(c[:3] for c in base), sorted(c[:3] for c in more)))
    return out


def planted(rng):
    bits = [
        "mail me at a.b@c.de", "contact jo [at] mail [dot] example [dot] org", "write x(at)y.com now", "server 10.0.0.1 and 300.1.1.1", "host 192[.]168[.]1[.]7", "ip 8 (dot) 8 (dot) 8 (dot) 8",
        "card 4111 1111-1111 1111", "visa 4111.1111.1111.1111", "visa 4111_1111_1111_1112", "amex 3782/822463/10005", "call +1 (555) 010-9999", "tel (212) 555-0100", "phone 212-555-0199", "id 123-456-7890123", "1.2.3.4.5.6.7.8",
        "a@b@c.d.e", "é\U0001f600 x", "v 2.0.1.9999", "just words", "@", "+1+2+3", "5555 5555 5555 4444 4444", "a@b.c,d@e.f;g@h.i",
    ]
    return " ".join(rng.choice(bits, rng.integers(0, 30)).tolist())


def test_personal_data(spark):
    rng = np.random.default_rng(0)
    texts = [planted(rng) for _ in range(300)] + ["", "a@b.cd" * 50, "1 " * 50_000, "+1 " * 1000 + "(" * 5000, "@" * 10_000, "x" * 50_000 + "@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: ([(s.start, s.end, s.kind) for s in r.base], [(s.start, s.end, s.kind) for s in r.added]) for r in pii.find(docs).collect()}
    want = plain_spans(texts)
    assert {i: tuple(map(sorted, x)) for i, x in got.items()} == dict(enumerate(want))
    added = Counter(pii.KINDS[k] for _, more in want for _, _, k in more)
    assert set(added) == set(pii.KINDS) and sum(len(b) for b, _ in want) > 500


def test_reliabilities_count_patterns_as_rows():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    rates = [(0.9, 0.2), (0.7, 0.1), (0.6, 0.3), (0.8, 0.4), (0.95, 0.05)]
    votes = np.stack([np.where(truth, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates], axis=1).astype(int)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    prior, found, post = pii.reliabilities(patterns)
    assert prior == pytest.approx(0.4, abs=0.05)
    for got, want in zip(found, rates, strict=True):
        assert got == pytest.approx(want, abs=0.06)
    sure = dict(zip([v for v, _ in patterns], post, strict=True))
    assert np.mean([(sure[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.93


def test_many_matches_take_time_in_proportion(spark):
    took = []
    for n in (25_000, 200_000):
        text = "".join(f"u{i}@h.de, " for i in range(n))
        begun = time.perf_counter()
        r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.perf_counter() - begun)
        assert len(r.base) == n and text[r.base[-1].start : r.base[-1].end] == f"u{n - 1}@h.de"
    assert took[1] < 60


def test_logs_fold_back(spark):
    """Without its edits, deltas or regenerations the derived log gives other messages."""
    rows = [(1, 0, "user", "Hello there"), (1, 1, "assistant", "Hi, é\U0001f600!"), (1, 2, "user", ""), (1, 3, "assistant", "x"), (None, 5, "system", "a\\<|end|>"), (None, 5, "assistant", None), (2, 0, "assistant", "long " * 50_000)]
    c = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq long")
    events = chat.conversation_events(c)
    assert Counter(r.kind for r in events.collect()) == {"message": 7, "edit": 3, "delta": 12, "regenerate": 4}
    shown = lambda e: sorted((r.conv_id or -1, r.turn, r.role, r.text) for r in chat.fold_events(e).collect())
    want = sorted((i or -1, t - 4 if i is None else t + 1, role, text or "") for i, t, role, text in rows if not (i is None and role == "system"))
    want = sorted([*[w for w in want if w[0] != -1], (-1, 1, "assistant", ""), (-1, 2, "system", "a\\<|end|>")])
    assert shown(events) == want
    for kind in ("edit", "delta", "regenerate"):
        assert shown(events.filter(F.col("kind") != kind)) != want
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert turns[1] == [(r, t) for i, _, r, t in rows if i == 1] and turns[None] == [("assistant", ""), ("system", "a\\<|end|>")]
    assert chat.render(chat.fold_events(chat.conversation_events(c.limit(0)))).count() == 0


def test_hot_keys_are_spread(spark, monkeypatch):
    """With every key hot: the same components as without, and as a plain version gives."""
    from tests.llm.test_operators import brute_components

    monkeypatch.setattr(common, "LEAST_HOT", 1)
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 1)
    monkeypatch.setattr(common, "SPREAD", 5)
    rng, texts = np.random.default_rng(5), []
    base = [f"b{i}" for i in range(80)]
    for _ in range(150):
        own = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 5)):
            own[k] = f"e{rng.integers(0, 6)}"
        texts.append(own)
    texts += [[f"c{i}" for i in range(2 * k, 2 * k + 60)] for k in range(30)] + [base] * 40 + [[f"p{i}" for i in range(60)] + [f"q{k}x{i}" for i in range(8 + k % 5)] for k in range(60)]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == want
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(docs).collect()) == sorted({c for _, _, c in want})


def test_settled_tables_leave_no_shuffle_files(spark):
    """Also those of the sketch: what one step shuffled is off the disk before the next, without waiting for the driver's garbage collection."""

    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for k in range(blocks.size()) if (name := blocks.apply(k).name()).startswith("shuffle_")}

    def left(before):
        end = time.time() + 10
        while (new := shuffled() - before) and time.time() < end:
            time.sleep(0.2)
        return new

    was, before = spark.conf.get(common.CLEANUP), shuffled()
    sums = spark.range(1000).groupBy((F.col("id") % 70).alias("k")).agg(F.sum("id").alias("s"))
    table = common.settle(sums.join(spark.range(50).groupBy((F.col("id") % 60).alias("k")).count().hint("merge"), "k"), "test-sums")
    assert {(r.k, r.s) for r in table.collect()} == {(k, sum(range(k, 1000, 70))) for k in range(50)} and not left(before)
    before = shuffled()
    ngram_join.frequency_levels(spark.createDataFrame([("a b c d e f",)], "text string"))
    assert not left(before) and spark.conf.get(common.CLEANUP) == was


def test_sketch_counts_of_any_size(spark):
    """Counters of one partition that need one, two and four bytes."""
    texts = {"a b c d e": 70_000, "f g h i j": 300, "k l m n o": 1}
    rows = spark.createDataFrame(list(texts.items()), "text string, n int").selectExpr("text", "explode(sequence(1, n))").coalesce(1)
    levels = ngram_join.frequency_levels(rows)
    load = 70_301 / ngram_join.SLOTS
    for (s,), n in zip(ngram_join.shingle_sets(list(texts)), texts.values(), strict=True):
        above = (n - load) / max(load, 1) ** 0.5
        assert levels[int(s) % ngram_join.SLOTS] == int(min(ngram_join.FINE // 2 + min(4 * above, ngram_join.FINE // 2) + math.log2(max(above - ngram_join.FINE // 8 + 1, 1)), 63))
    assert np.count_nonzero(levels != levels.min()) == 3


def test_templates_that_do_not_link_make_few_pairs(spark, monkeypatch):
    """Pages that share most of a template, but less than links need: the pairs that meet don't grow with the square of the pages."""
    pairs = []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda p, *rest: (pairs.append(p.distinct().count()), whole(p, *rest))[1])
    found = []
    for n in (300, 1200):
        pairs.clear()
        rows = [(k, " ".join([f"t{i}" for i in range(100)] + [f"own{k}x{i}" for i in range(20 + k % 3)])) for k in range(n)]
        got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert got.filter("component_id <> doc_id").count() == 0
        found.append(sum(pairs))
    assert found[1] <= 8 * max(found[0], 300)


def plain_statistics(text):
    data, words, lines = list(text.encode()), text.split(), text.split("\n")
    n, kinds, ascii_ = max(1, len(data)), Counter(words), [chr(b) if b < 128 else "" for b in data]
    own = Counter(c for c in ascii_ if c and not c.isalnum() and c not in " \t\n\v\f\r.,")
    share = [k / n for k in Counter(data).values()]
    pairs = {(a, b) for a, b in zip(words, words[1:], strict=False)}
    return [
        math.log(1 + len(text)), math.log(1 + len(words)), len(text) / max(1, len(words)), sum(c.isupper() for c in ascii_) / n, sum(c.isdigit() for c in ascii_) / n, sum(own.values()) / n,
        sum(b >= 128 for b in data) / n, sum(c in " \t\n\v\f\r" and c != "" for c in ascii_) / n, len(kinds) / max(1, len(words)), max(kinds.values(), default=0) / max(1, len(words)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), math.log(1 + len(lines)), len(set(lines)) / len(lines), math.log(1 + len(text) / len(lines)),
        sum(x[:1].islower() for x in lines) / len(lines), text.count(".") / max(1, len(words)), -sum(p * math.log2(p) for p in share),
        sum(len(w) <= 3 for w in kinds) / max(1, len(kinds)), len(pairs) / max(1, len(words) - 1), max(own.values(), default=0) / n,
    ]


def test_quality_statistics_and_trees(spark):
    rng = np.random.default_rng(6)
    texts = ["", " ", "\n", "A b. C!", "é\U0001f600 \x00\x7f~~ 12", "a a a\na a\n\nB, b", "word " * 30_000] + ["".join(rng.choice(list("aB1 .,!\né"), 200)) for _ in range(50)]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-12)
    x, y = rng.random((200, 4)).round(2), (rng.random(200) < 0.5).astype(float)
    forest = quality.grow(x, y, trees=3, depth=2, bins=16)
    margin = np.full(200, forest.start)
    for k in range(3):  # every split is the best of all, every leaf the Newton step
        g, h = 1 / (1 + np.exp(-margin)) - y, 0
        p = g + y
        h = p * (1 - p)

        def gain(rows, f, c):
            left = rows & (x[:, f] <= c)
            right = rows & ~left
            if h[left].sum() < 1e-3 or h[right].sum() < 1e-3:
                return 0.0
            return g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)

        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
        parts = {0: np.ones(200, bool)}
        for node in range(3):
            best = max(gain(parts[node], f, c) for f in range(4) for c in edges[f])
            f, c = forest.feature[k, node], forest.cut[k, node]
            assert gain(parts[node], f, c) == pytest.approx(max(best, 0), abs=1e-9)
            parts[2 * node + 1], parts[2 * node + 2] = parts[node] & (x[:, f] <= c), parts[node] & (x[:, f] > c)
        for leaf in range(4):
            rows = parts[3 + leaf]
            assert forest.value[k, leaf] == pytest.approx(-0.2 * g[rows].sum() / (h[rows].sum() + 1))
            margin[rows] += forest.value[k, leaf]
    assert forest.margin(x) == pytest.approx(margin)


def test_quality_of_a_table(spark):
    rng = np.random.default_rng(7)
    good = lambda: " ".join(f"word{k}" for k in rng.integers(0, 500, 80)) + "."
    bad = lambda: "!!! " * int(rng.integers(10, 80))
    texts = [(good if i % 2 else bad)() for i in range(400)] + [None, "", "x" * 3_000_000]
    docs = spark.createDataFrame([(i, t, "en", 9.5) for i, t in enumerate(texts)], "doc_id long, text string, y string, score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, forest).collect()}
    want = forest.score(np.array([plain_statistics(t or "") for t in texts]))
    assert [rows[i].score for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(rows[i].predicted == i % 2 for i in range(400))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.predicted)


def plain_features(blob, rank):
    """The places of the features of a text that isn't short."""
    n, w = len(blob) - fingerprints.WINDOW + 1, fingerprints.WINDOW
    ranks = [rank[int(h)] for h in plain_entropies(blob)]
    points = Counter()
    for run in range(n - w + 1):
        points[min(range(run, run + w), key=lambda k: (ranks[k], k))] += 1
    return [k for k in range(n) if points[k] >= fingerprints.POINTS and ranks[k] != fingerprints.UNRANKED]


def plain_entropies(blob):
    table = fingerprints._CLOGC
    return [1000 - int(sum(table[c] for c in Counter(blob[k : k + 64]).values())) * 1000 // int(table[64]) for k in range(len(blob) - 63)]


def texts_of_bytes(rng):
    out = [bytes(rng.choice(list(b"abcdefgh ,.\n"), int(n)).tolist()) for n in rng.integers(500, 900, 12)]
    return [*out, b"a" * 500, bytes(range(256)) * 2, out[0][:400] + out[1][:200], b"", b"tiny", out[2][:383], out[2][:384]]


def test_fingerprint_features_filters_and_likeness(monkeypatch):
    rng = np.random.default_rng(8)
    blobs = texts_of_bytes(rng)
    for blob in blobs:
        assert fingerprints.entropies(np.frombuffer(blob, np.uint8)).tolist() == plain_entropies(blob)
    counts = Counter(h for b in blobs for h in plain_entropies(b))
    assert fingerprints.window_levels(blobs).tolist() == [counts[k] for k in range(fingerprints.LEVELS)]
    rank = fingerprints.rarity(fingerprints.window_levels(blobs))
    order = sorted(range(1001), key=lambda k: (counts[k], k))
    assert all(rank[k] == (order.index(k) if 100 <= k < 991 else fingerprints.UNRANKED) for k in range(1001))
    whole = fingerprints.features(blobs, rank)
    for group in (fingerprints.GROUP_BYTES, 300):  # the second cuts long texts
        monkeypatch.setattr(fingerprints, "GROUP_BYTES", group)
        owner, h = fingerprints.features(blobs, rank)
        assert owner.tolist() == whole[0].tolist() and h.tolist() == whole[1].tolist()
        for i, blob in enumerate(blobs[:12]):
            places = np.array(plain_features(blob, rank), np.int64)
            assert h[owner == i].tolist() == fingerprints._hashes(np.frombuffer(blob, np.uint8), places).tolist() and len(places)
    monkeypatch.undo()
    made = fingerprints.digests(blobs, rank)
    bits = []
    for i in range(len(blobs)):  # a set of bits per 160 features
        own = [int(x) for x in whole[1][whole[0] == i]]
        bits.append([{(x >> (11 * k + 4)) % 2048 for x in own[at : at + 160] for k in range(5)} for at in range(0, len(own), 160)])
        assert [set(np.flatnonzero(np.unpackbits(f.view(np.uint8))).tolist()) for f in made[i]] == bits[i]
        assert (fingerprints.read_digest(fingerprints.written(made[i])) == made[i]).all()

    def overlap(x, y):
        chance = len(x) * len(y) / 2048
        return min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9)))

    pairs = [(i, j) for i in range(len(blobs)) for j in range(len(blobs))]
    got = fingerprints.likeness([(made[i], made[j]) for i, j in pairs])
    for (i, j), value in zip(pairs, got, strict=True):
        x, y = sorted((bits[i], bits[j]), key=len)
        if not x or not y:
            want = float(not x and not y)
        else:
            want = sum(len(f) * max(overlap(f, e) for e in y) for f in x) / sum(map(len, x))
        assert value == pytest.approx(want, abs=1e-9)


def test_fingerprints_of_a_table(spark):
    """Long texts and shared ids over several ranges, against digests made one by one."""
    rng = np.random.default_rng(9)
    texts = ["".join(chr(97 + k) if k < 26 else " " for k in rng.integers(0, 30, n)) for n in [400] * 30 + [200] * 10 + [2_500_000, 0, 700]]
    rows = [(i // 2 if i < 20 else i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    levels = fingerprints.window_levels([t.encode() for t in texts])
    assert fingerprints.corpus_rarity(docs).tolist() == fingerprints.rarity(levels).tolist()
    rank = fingerprints.rarity(levels)
    ordered = sorted((i, t) for i, t, _ in rows)
    got = Counter()
    for r in fingerprints.fingerprint(docs).collect():
        got[r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)] += 1
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        changed = fingerprints.edited(t, after)
        own, theirs, nxt = fingerprints.digests([t.encode()], rank)[0], fingerprints.digests([changed.encode()], rank)[0], fingerprints.digests([after.encode()], rank)[0]
        near = fingerprints.likeness([fingerprints.comparable(t.encode(), own, changed.encode(), theirs), fingerprints.comparable(t.encode(), own, after.encode(), nxt)])
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.written(own), round(near[0], 9), round(near[1], 9)] += 1
    assert got == want


def test_blocks_that_are_taken(spark):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", None][int(rng.integers(0, 4))]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    shards = {}
    for r in found:
        shards.setdefault((r.nth, r.shard), []).append(r)
    taken = Counter()
    for own in shards.values():
        own.sort(key=lambda r: r["first"])
        head, words = own[0], [r.doc_id for r in own for _ in range(r["size"])]
        assert len(words) == head.shard_size and (not words or math.gcd(head.step, head.blocks) == 1)
        edges = [j * len(words) // head.blocks for j in range(head.blocks + 1)] if words else [0]
        once = 0
        for j in range(len(edges) - 1):
            more = (j * head.step + head.turn) % head.blocks < head.extra
            once += more
            for i in words[edges[j] : edges[j + 1]]:
                taken[i] += head.each + more
        assert once == (head.extra if words else 0) and all(abs(edges[j + 1] - edges[j] - len(words) / head.blocks) < 1 for j in range(len(edges) - 1))
    assert {r.doc_id: r.taken for r in found} == {i: taken[i] for i, _, _ in rows}
    by_source = Counter()
    for r in found:
        by_source[r.nth] += r.taken
    assert all(abs(by_source[r.nth] - r.target) <= 2 * mixing.BLOCK for r in found)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in found}  # reruns agree


def test_token_counts_with_little_memory(monkeypatch):
    """The transducer forgets its states within long pre-tokens, and counts as before."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), 30_000)), "the cat " * 500, "x" * 5000, "".join(rng.choice(list("!?#$%"), 9000))]
    want = token_count.count_tokens(texts, path)
    memo, _ = token_count.compiled(path)
    monkeypatch.setattr(token_count, "CACHED", 50)
    monkeypatch.setattr(token_count, "BLOCK", 97)
    memo.clear()
    assert token_count.count_tokens(texts, path) == want and len(memo) <= 50 and max(map(len, memo)) <= token_count.LONGEST


def test_scratch_tables_are_removed(spark):
    import os

    folder = common.shared_folder(spark)
    before = set(os.listdir(folder))
    with common.scratch(spark) as made:
        a = common.settle(spark.range(3), "scratch-a")
        b = common.settle(a.filter("id > 0"), "scratch-b")
        made.pop()
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"b"} and b.count() == 2
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.settle(spark.range(3), "scratch-c")
        1 / 0  # noqa: B018
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"b"}


def test_stages_keep_columns_of_any_name(spark):
    from streamloom.llm import exact_dedup

    names = ["_hash", "_norm", "_nth", "_id", "_key", "_row", "h", "row", "norm", "nth", "_salt", "best", "class", "a b", "x.y"]
    rows = [(i, "word " * 6 + str(i // 2), "s", 1, *(f"{n}{i}" for n in names)) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", "n_chars long", *(f"`{n}` string" for n in names)]))
    for stage in (exact_dedup.drop_copies, ngram_join.drop_near_copies):
        assert sorted(map(tuple, stage(docs).collect())) == [rows[0], rows[2]]
    for r in mixing.mixed_documents(docs).collect():
        assert tuple(r)[4:] == rows[r.doc_id][4:]


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_of_large_groups(spark, monkeypatch, hot):
    from streamloom.llm import exact_dedup

    if hot:
        monkeypatch.setattr(common, "LEAST_HOT", 1)
        monkeypatch.setattr(common, "SPREAD", 7)
    rng = np.random.default_rng(12)
    texts = ["Copy", "COPY", "copy", "É", "é", "", None, "a b", "a  b"]
    rows = [(int(i), texts[int(k)]) for i, k in zip(rng.permutation(600), rng.choice(9, 600, p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.1, 0.05, 0.05, 0.05]), strict=True)]
    rows += [(i, f"own {i}") for i in range(600, 700)] + [(650, "own 650"), (None, "none"), (None, "none"), (None, "copy")]
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want, seen = Counter(), set()
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = max(ids, default=None)
        first = i is not None and i == keep and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        want[i, keep, len(groups[norm(t)]), first, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, keep="max").collect())) == want
