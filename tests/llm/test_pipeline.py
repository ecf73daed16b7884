"""Every stage of the corpus pipeline against a plain version of it, each on its own input, and run() as their composition."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from streamloom.llm import byte_bpe, quality
from streamloom.llm.common import ascii_lower_py

tokenizers = pytest.importorskip("public_tokenizers")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the provided tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The provided documents, and rows with null and empty texts, a null source and a repeated row."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    some = docs.orderBy("doc_id").first()
    more = spark.createDataFrame([(10**6, None, "en", "web", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, some.text, None, None, None), tuple(some)], docs.schema)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/after{k}")
        docs = spark.read.parquet(f"{folder}/after{k}")
        found.append(docs.collect())
    return found


def words(text):
    return WORD.findall(text or "")


def test_quality_keeps_what_scores_well(spark, folder, steps):
    before, after = Counter(steps[0]), Counter(steps[1])
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    score = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert after == Counter({r: n for r, n in before.items() if score[r.doc_id] == 1}) and 0 < sum(after.values()) < sum(before.values())


def test_exact_dedup_keeps_the_smallest_id(steps):
    least = {}
    for r in steps[1]:
        key = ascii_lower_py(r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    want = {r for r in steps[1] if least[ascii_lower_py(r.text or "")] == r.doc_id}
    assert Counter(steps[2]) == Counter(want)


def test_near_dedup_keeps_the_smallest_id_of_a_component(steps):
    sets, holders = {}, defaultdict(set)
    for r in steps[2]:
        w = words(ascii_lower_py(r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            holders[s].add(r.doc_id)
    links = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least, before = {i: i for i in sets}, None
    while least != before:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert Counter(steps[3]) == Counter(r for r in steps[2] if least[r.doc_id] == r.doc_id)
    assert len(steps[3]) < len(steps[2])


def test_mixing_meets_the_targets(steps):
    size, taken, sources = Counter(), Counter(), {}
    whole = {r.doc_id: r for r in steps[3]}
    for r in steps[3]:
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: float(3 * size[s]) for s in full} | share
    copies = defaultdict(list)
    for r in steps[4]:
        assert (r.lang, r.source) == (whole[r.doc_id].lang, whole[r.doc_id].source) and r.n_chars == len(r.text)
        copies[r.doc_id].append(r.text)
        taken[r.source] += len(words(r.text))
        sources[r.source] = True
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.1, abs=300)
    for i, texts in copies.items():
        own = words(whole[i].text)
        assert sum(len(words(t)) for t in texts) <= 3 * len(own)
        parts = [t for t in texts if t != whole[i].text]
        assert len(parts) <= 1 and not Counter(w for t in parts for w in words(t)) - Counter(own)


def test_tokens_are_the_librarys(steps):
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    coder = byte_bpe.encoding(ranks, tokenizers.PATTERN)
    want = Counter()
    for r in steps[4]:
        ids = coder.encode_ordinary(r.text or "")
        want[r.doc_id, tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in steps[5]) == want


def test_run_composes_the_stages(spark, folder, steps):
    got = corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, r.ids_sha256) for r in steps[5])


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
