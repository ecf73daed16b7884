"""Edge cases of every operator on one small table, against plain versions: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import byte_bpe, chat, exact_dedup, fingerprints, lm, mixing, ngram_join, pii, quality, token_count
from streamloom.llm.common import ascii_lower_py

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, n long, class long, size long, keep_id long"
WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, "Hello big World, it's a test", "a"), (2, None, None), (3, "", "a"), (4, "hello big world, it's A test", "b"), (5, "a b", "b"), (5, "a b", "b"), (6, WORDS, "a"),
    (7, WORDS + " x", "c"), (8, "  \n\n x\t y  é½ don't <|endoftext|> z", "c"), (9, "mail a.b@c.de.fg or 10.0.0.255, 999.1.1.1, 4111 1111-1111 1111 +1 (555) 010-9999.", "a"), (None, "null id", "a"),
    (10, ("lorem ipsum " * 3000) + "ende", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, 3, 4) for i, t, s in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs, keep="max").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS)
    assert (by[1].keep_id, by[1].group_size, by[1].kept, by[4].kept) == (4, 2, False, True)
    assert by[2].keep_id == 3 and by[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.kept for r in rows if r.doc_id == 5) == [False, True] and by[None].kept is False
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_byte_bpe_and_token_counts(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    for r in token_count.token_counts(docs.dropDuplicates(["doc_id"]), tokenizers.path("byte_bpe_50k.json")).collect():
        text = next(t for i, t, _ in TEXTS if i == r.doc_id) or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    for r in byte_bpe.round_trip(docs, ranks, tokenizers.PATTERN).collect():
        text = next(t for i, t, _ in TEXTS if i == r.doc_id) or ""
        ids = byte_bpe.encoding(ranks, tokenizers.PATTERN).encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.round_trip(empty, ranks, tokenizers.PATTERN).count() == 0


def test_pii(docs, empty):
    r = pii.find(docs).filter("doc_id = 9").first()
    text = next(t for i, t, _ in TEXTS if i == 9)
    assert [(pii.KINDS[s["kind"]], text[s["start"] : s["end"]]) for s in sorted(r.base, key=lambda s: s["start"])] == [("email", "a.b@c.de.fg"), ("ip", "10.0.0.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert pii.find(docs).count() == len(TEXTS) and pii.find(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in TEXTS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(rows) == len(TEXTS) and all(r.taken <= 3 * r.size for r in rows)
    assert sum({r.nth: r.target for r in rows}.values()) == pytest.approx(sum(sizes.values()))
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_sainte_lague(spark):
    votes = [53, 24, 23, 7, 1]
    for seats in (0, 1, 7, 23, 100):
        p = spark.createDataFrame([(0, i, float(v), float(seats)) for i, v in enumerate(votes)], "g int, i int, v double, s double")
        got = {r.i: r.won for r in mixing.sainte_lague(p, ["g"], "i", "v", "s").collect()}
        best = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats)))[:seats]
        assert got == {i: sum(j == i for _, j in best) for i in range(len(votes))}


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint(docs).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(((-1 if i is None else i, t or "") for i, t, _ in TEXTS))
    for r in rows:
        k = [i for i, _ in order].index(-1 if r.doc_id is None else r.doc_id) + (r.doc_id == 5 and r.edited_sha256 != hashlib.sha256(b"a b"[:2] + b"a").hexdigest())
        text, after = order[k][1], order[(k + 1) % len(order)][1]
        assert r.edited_sha256 == hashlib.sha256(fingerprints.edited(text, after).encode()).hexdigest() and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert fingerprints.fingerprint(empty).count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower_py(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp, before = {i: i for i in sets}, None
    while comp != before:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {(i, len(s), comp[i]) for i, s in sets.items()}


def test_ngram_join(spark, docs, empty):
    base = [f"t{i}" for i in range(100)]
    more = [(100 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 100, 9)] + [(300, " ".join(base)), (301, " ".join(base).upper()), (302, " ".join(base[:60]))]
    texts = [(i, t) for i, t, _ in TEXTS if i is not None] + more
    both = spark.createDataFrame(texts, "doc_id long, text string")
    rows = ngram_join.ngram_join(both).collect()
    assert len(rows) == len(texts)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == brute_components(texts)
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_clusters_and_short_texts(spark):
    """Edited copies of which many link with none, chains, and short texts whose rarest shingles agree though they don't link."""
    rng, texts = np.random.default_rng(3), []
    for length, copies, edits in ((60, 60, 4), (150, 60, 6), (13, 60, 2), (14, 30, 3)):
        base = [f"b{length}x{i}" for i in range(length)]
        for _ in range(copies):
            own = list(base)
            for k in rng.integers(0, length, rng.integers(0, edits + 1)):
                own[k] = f"e{rng.integers(0, 4)}"
            texts.append(own[: length - rng.integers(0, 3)])
    for k in range(40):
        texts.append([f"c{i}" for i in range(3 * k, 3 * k + 80)])
        texts.append([f"h{i}" for i in range(9)] + [f"v{k % 6}", f"v{k % 5}", f"v{k % 7}", f"v{k}"][: 1 + k % 4])
    texts = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows = ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_chat(spark):
    turns = [(1, 0, "user", "a <|end|> \\ <\\| |> x"), (1, 1, "assistant", "<|turn:user|>\\"), (1, 2, "assistant", None), (2, 0, None, "<"), (2, 0, None, "<"), (3, 0, "end|>", "")]
    c = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.conversation_events(c))).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", turns[0][3]), ("assistant", turns[1][3]), ("assistant", "")], 2: [("", "<"), ("", "<")], 3: [("end|>", "")]}
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "Hel"), (1, 3, "delta", 2, "assistant", "lo"), (1, 4, "regenerate", 2, "assistant", ""), (1, 5, "delta", 2, "assistant", "Yo"), (1, 6, "edit", 1, "user", "hey"), (1, 7, "delta", 1, "user", "!")]
    e = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    assert [(r.role, r.text) for r in chat.fold_events(e).orderBy("turn").collect()] == [("user", "hey!"), ("assistant", "Yo")]
    assert chat.fold_events(e.limit(0)).count() == 0


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.6).astype(float)
    forest = quality.grow(x, y, trees=20)
    assert (((forest.score(x) > 0.5) == (y > 0.5)).mean()) > 0.97
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6, 11)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == len(TEXTS)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_lm(docs, empty):
    rows = lm.score(docs).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    counts = Counter()
    for i, t, _ in TEXTS:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            counts.update(words(t))
    total = sum(counts.values())
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = words(next(t for i, t, _ in TEXTS if i == r.doc_id))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own))
    assert lm.score(empty).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = lm.first_model(np.full(20, 0.05))
    lengths = np.array([1, 64, 65, 200])
    classes = rng.integers(0, 20, lengths.sum())
    at = 0
    for n, got in zip(lengths, lm.log_likelihoods(classes, lengths, model), strict=True):
        a = model.start * model.emit[classes[at]]
        for k in classes[at + 1 : at + n]:
            a = (a @ model.step) * model.emit[k]
        at += n
        assert got == pytest.approx(math.log10(a.sum()))


def test_mixed_documents_are_whole(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        text = "".join(f"{w}{' ' if k % 7 else chr(10)}" for k, w in enumerate(f"d{i}w{k}" for k in range(rng.integers(20, 60))))
        rows.append((i, text, "abc"[i % 3], len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    target = {r.nth: r.target for r in mixing.mix(docs).collect()}
    size, words, cut, copies = Counter(), Counter(), Counter(), Counter()
    for i, t, s, _ in rows:
        size[s] += len(t.split())
    for r in mixing.mixed_documents(docs).collect():
        whole = rows[r.doc_id][1]
        assert whole.startswith(r.text) and r.n_chars == len(r.text)
        copies[r.doc_id] += 1
        words[r.source] += len(r.text.split())
        cut[r.source] += r.text != whole
    assert all(n <= 1 for n in cut.values()) and max(copies.values()) <= 3
    assert min(target[1 + k] / size[s] for k, s in enumerate("abc")) < 1
    assert all(abs(words[s] - target[1 + k]) <= 2 * mixing.BLOCK for k, s in enumerate("abc"))


def test_drop_copies_keeps_texts_without_ids(spark):
    rows = [(None, "only"), (None, "ONLY"), (None, "shared"), (7, "Shared"), (9, "shared"), (None, "own"), (8, "other")]
    for keep, shared in (("min", (7, "shared")), ("max", (9, "shared"))):
        kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), keep).collect()
        assert Counter((r.doc_id, r.text.lower()) for r in kept) == Counter([(None, "only"), shared, (None, "own"), (8, "other")])


def test_drop_near_copies_of_repeated_and_null_ids(spark):
    base = lambda p: [f"{p}{i}" for i in range(60)]
    near = lambda p, k: " ".join(base(p)[:k] + ["new"] + base(p)[k + 1 :])
    rows = [(1, near("a", 0)), (5, near("a", 59)), (5, "clean " + " ".join(base("b")))]  # a clean row and a near copy share an id
    rows += [(3, near("c", 0)), (3, near("c", 59)), (4, near("c", 1))]  # near copies under the smallest id
    rows += [(None, near("d", 0)), (9, near("d", 59)), (8, near("d", 1))]
    rows += [(None, near("e", 0)), (None, near("e", 59)), (6, near("f", 0)), (6, near("f", 0)), (None, None), (None, "")]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, (r.text or "").split(" ")[-1][:1]) for r in kept)
    assert len(kept) == 8 and {r.doc_id for r in kept if "d5" in (r.text or "")} == {8}
    assert got[5, "b"] == 1 and got[1, "a"] == 1 and sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id == 6 for r in kept) == 1
    assert sum("e5" in (r.text or "") for r in kept) == 1 and sum(not r.text for r in kept) == 2


def test_expected_counts_are_exact():
    """Against the plain recursion over whole texts, also texts of several segments."""
    rng = np.random.default_rng(1)
    model = lm.first_model(np.full(20, 0.05))
    model.step = rng.random((4, 4)) + 0.1
    model.step /= model.step.sum(axis=1, keepdims=True)
    lengths = np.array([1, 64, 512, 513, 1500])
    classes = rng.integers(0, 20, lengths.sum())
    starts, steps, emit, at = np.zeros(4), np.zeros((4, 4)), np.zeros((20, 4)), 0
    for n in lengths:
        own, at = classes[at : at + n], at + n
        alphas, scales = [], []
        for t in range(n):
            a = (alphas[-1] @ model.step if t else model.start) * model.emit[own[t]]
            scales.append(a.sum())
            alphas.append(a / a.sum())
        beta = np.ones(4)
        for t in range(n - 1, -1, -1):
            emit[own[t]] += alphas[t] * beta
            if t:
                onward = model.emit[own[t]] * beta / scales[t]
                steps += model.step * np.outer(alphas[t - 1], onward)
                beta = model.step @ onward
        starts += alphas[0] * beta
    for got, want in zip(lm.expected_counts(classes, lengths, model), (starts, steps, emit), strict=False):
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_lm_scales_now_and_then(monkeypatch):
    """Not at every token, also where the only state that can emit a token is one that is hard to reach."""
    rng = np.random.default_rng(3)
    emit = np.where(np.arange(20)[:, None] % 4 == np.arange(4), 1.0, 1e-12)
    model = lm.Model(np.full(4, 0.25), (1 - 4e-9) * np.eye(4) + 1e-9, emit / emit.sum(axis=0))
    lengths = np.array([1, 7, 8, 9, 64, 300, 1023, 1025, 3000])
    classes, want, at = rng.integers(0, 20, lengths.sum()), [], 0
    for n in lengths:
        a, own = model.start, 0.0
        for t, k in enumerate(classes[at : at + n]):
            a = (a @ model.step if t else a) * model.emit[k]
            own, a = own + math.log10(a.sum()), a / a.sum()
        want.append(own)
        at += n
    calls, log10 = [], np.log10
    monkeypatch.setattr(np, "log10", lambda *x, **y: calls.append(0) or log10(*x, **y))
    got = lm.log_likelihoods(classes, lengths, model)
    assert len(calls) <= lm.SEGMENT // 4 + -(-lengths.max() // lm.SEGMENT) + 1
    assert got == pytest.approx(want) and lm.expected_counts(classes, lengths, model)[3] == pytest.approx(sum(want))


def test_lm_trains_on_all_texts_in_every_round(spark):
    """Texts over 20,000 bytes too, against rounds over all texts at once."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{k}" for k in (rng.integers(0, 30, n) + 30 * (i % 2))) for i, n in enumerate([4000] * 6 + [50] * 30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocab = lm.vocabulary(lm.word_counts(rows), len(texts))
    codes, lengths = vocab.code_arrays(texts, lm.Codes(vocab.heavy))
    want = lm.first_model(vocab.class_share)
    for _ in range(3):
        want = lm.refit(lm.expected_counts(vocab.class_of[codes], lengths, want)[:3], vocab.class_share)
    got = lm.train(rows, vocab, 3)
    assert got.emit == pytest.approx(want.emit, rel=1e-6) and got.step == pytest.approx(want.step, rel=1e-6)


def test_fingerprints_of_short_texts(spark):
    """An edited copy of a short text is told from another text, also where only one of the two is short."""
    rng = np.random.default_rng(4)
    lengths = [12, 40, 100, 126, 127, 160, 8, 126, 60, 150, 5]
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, n)) for n in lengths]
    rows = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if lengths[r.doc_id] < 127:
            assert r.near_edited > 0.2 > 0.15 > r.near_next
    assert {r.doc_id: r.near_edited > 0.3 for r in rows if r.doc_id == 5} == {5: True}  # 160 bytes, edited to 88


RUNS = {"spaces": " ", "newlines": "\n", "wide": "　", "mixed": " \n\t", "letters": "ab", "digits": "1", "signs": "!?\x1c", "quotes": "'s"}


@pytest.mark.parametrize("end", ["", "x", "\x1c", " y z"])
@pytest.mark.parametrize("run", RUNS)
def test_long_runs_are_tokenized_as_the_library_does(run, end):
    """Over PIECE_CHARS and SLICE_CHARS, and far over what the library takes in one go."""
    from tokenizers import Tokenizer

    ranks, path = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json")
    own, other = byte_bpe.encoding(ranks, tokenizers.PATTERN), Tokenizer.from_file(path)
    for n in (byte_bpe.PIECE_CHARS - 1, byte_bpe.PIECE_CHARS + 3, 150_000):
        text = "start. " + (RUNS[run] * n)[:n] + end + " then   some more\n\n" + "words " * 20_000
        ids = byte_bpe.encode(text, ranks, tokenizers.PATTERN)
        assert ids == own.encode_ordinary(text) and byte_bpe.decode(ids, ranks, tokenizers.PATTERN) == text.encode()
        if n == 150_000:
            assert token_count.count_tokens([text], path) == [len(other.encode(text, add_special_tokens=False).ids)]


def test_texts_of_ten_megabytes_round_trip(spark):
    ranks, path = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json")
    size = 10_000_000
    texts = [" " * size, "\n" * size, "a" * size, ("x " + " \n" * 500_000) * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = {r.doc_id: r for r in byte_bpe.round_trip(docs, ranks, tokenizers.PATTERN).collect()}
    stage = {r.doc_id: r.n_tokens for r in byte_bpe.tokenized(docs, ranks, tokenizers.PATTERN).select("doc_id", "n_tokens").collect()}
    counted = token_count.count_tokens(texts, path)
    for i, text in enumerate(texts):
        assert n[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert n[i].n_tokens == stage[i] == counted[i]


def test_stages_decide_by_content_where_ids_repeat(spark):
    """Rows that share an id, source and size but not the text, or the text but not other columns: any order of the input gives the
    same rows, none is lost."""
    long = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, long(c), "en", "s", n) for c in "abcdefgh" for n in (5, 6)] + [(None, long(c), "de", None, 7) for c in "pqr"] + [(2, "Same TEXT", "b", "s", 1), (2, "same text", "a", "s", 1), (2, "same TEXT", "a", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = []
    for order in (rows, rows[::-1], rows[7:] + rows[:7]):
        docs = spark.createDataFrame(order, schema).repartition(1 + len(got))
        got.append([Counter(f(docs).collect()) for f in (exact_dedup.drop_copies, ngram_join.drop_near_copies, mixing.mixed_documents)])
    assert got[0] == got[1] == got[2]
    exact, near, mixed = got[0]
    assert {tuple(r) for r in exact if r.doc_id == 2} == {(2, "Same TEXT", "b", "s", 1)} and sum(exact.values()) == 12
    assert sum(near.values()) == 12  # the three spellings have the same shingles
    assert all(any(t.startswith(r.text) for i, t, *_ in rows if i == r.doc_id) for r in mixed)  # one of a shard may be cut
    assert mixing.mixed_documents(spark.createDataFrame([(1, "a b", "s", 3)], "doc_id long, text string, source string, n_chars long")).count() == 1
