"""Document fingerprints: improbable-feature digests.

Every 64-byte window of a text has an entropy; entropies that are rare over the whole corpus rank first. In every run of 64
neighbouring windows the leftmost of the best rank gains a point, and windows with 16 points or more are the features. Their
hashes go, in order, into chained Bloom filters of 2048 bits (5 bits a feature, at most 160 features each). Two digests
compare by the overlap of their filters' bits, less what chance gives, normalised to 0..1.

A text under 127 bytes has no such run, and one under 384 bytes so few that an edit leaves hardly a feature in common: there every
8-byte window is a feature, with 7 zero bytes before and after the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import id_and_text, in_batches, read, sliced

WINDOW = 64
POINTS = 16
SHORT_WINDOW = 8
#: Texts of fewer bytes have too few runs of windows; with one of these, texts up to COMPARED bytes compare by short windows too.
SHORT, COMPARED = 6 * WINDOW, 12 * WINDOW
LEVELS = 1001
UNRANKED = 1023
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
GROUP_BYTES = 1_000_000
_SCALE = 1 << 16
_C = np.arange(WINDOW + 1)
_CLOGC = np.round(_C * np.log2(np.maximum(_C, 1)) * _SCALE).astype(np.int64)
_GAIN = np.append(np.diff(_CLOGC), 0)


def entropies(a: np.ndarray) -> np.ndarray:
    """The entropy, 0 to 1000, of every 64-byte window of an array of bytes (integers: the same window always gets the same).

    A window's sum of c*log(c) over byte counts c follows from the one before: the byte that leaves has so many equals ahead
    in the window, the byte that enters so many behind it.
    """
    n = len(a)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    key = a[order].astype(np.int32) * np.int32(n + WINDOW) + order.astype(np.int32)
    reach = np.searchsorted(key, key + np.int32(WINDOW - 1), side="right")
    at = np.arange(n)
    ahead, behind = np.empty(n, np.uint8), np.empty(n, np.uint8)
    ahead[order] = reach - at - 1
    behind[order] = at - np.cumsum(np.bincount(reach, minlength=n + 1))[:n]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _CLOGC[np.bincount(a[:WINDOW])].sum()
    if n > WINDOW:
        np.cumsum(_GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW]], out=total[1:])
        total[1:] += total[0]
    return 1000 - total * 1000 // _CLOGC[WINDOW]


def _inside(ends: np.ndarray, lengths: np.ndarray, n: int, short: int) -> np.ndarray:
    """Which of n places have at least `short` more bytes of the same text behind them."""
    out = np.ones(n, bool)
    for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
        out[max(end - length, end - short) : end] = False
    return out


def window_levels(blobs: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    total = np.zeros(LEVELS, np.int64)
    for group in _groups(blobs):
        a = np.frombuffer(b"".join(group), np.uint8)
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        h = entropies(a)
        total += np.bincount(h[_inside(np.cumsum(lengths), lengths, len(a), WINDOW - 1)[: len(h)]], minlength=LEVELS)
    return total


def _groups(blobs: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for blob in blobs:
        for at in range(0, max(1, len(blob)), GROUP_BYTES):
            piece = blob[at : at + GROUP_BYTES + WINDOW - 1] if len(blob) > GROUP_BYTES else blob
            if group and size + len(piece) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append(piece)
            size += len(piece)
    if group:
        yield group


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, the rarest first; near-constant and near-random windows say little and aren't ranked."""
    rank = np.empty(LEVELS, np.int32)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    rank[:100] = rank[991:] = UNRANKED
    return rank


def _select(a: np.ndarray, lengths: np.ndarray, rank_of: np.ndarray) -> np.ndarray:
    """Places of the features in texts that lie one behind the other."""
    n, ends = len(a), np.cumsum(lengths)
    m = n - WINDOW + 1
    if m < WINDOW:
        return np.zeros(0, np.int64)
    rank = rank_of[entropies(a)]
    rank[~_inside(ends, lengths, n, WINDOW - 1)[:m]] = UNRANKED
    best = (rank << 21) | np.arange(m, dtype=np.int32)
    step = 1
    while step < WINDOW:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    whole = _inside(ends, lengths, n, 2 * WINDOW - 2)[: len(best)]
    points = np.bincount(best[whole] & ((1 << 21) - 1), minlength=m)
    return np.flatnonzero((points >= POINTS) & (rank != UNRANKED))


def _hashes(a: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(a, WINDOW)[places].view(np.uint64) if len(places) else np.zeros((0, 8), np.uint64)
    h = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _short_hashes(blob: bytes) -> np.ndarray:
    """The hashes of all short windows of a text that isn't empty."""
    pad = bytes(SHORT_WINDOW - 1)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(pad + blob + pad, np.uint8), SHORT_WINDOW)
    h = np.ascontiguousarray(windows).view(np.uint64)[:, 0]
    for _ in range(2):
        h = (h ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def features(blobs: list[bytes], rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every feature, in order. A short text has all its short windows; another text
    without features (a uniform one) has itself as its one feature; an empty text has none."""
    owners, hashes = [], []
    at = 0
    while at < len(blobs):
        end, size = at, 0
        while end < len(blobs) and (end == at or size + len(blobs[end]) <= GROUP_BYTES):
            size += len(blobs[end])
            end += 1
        lengths = np.fromiter(map(len, blobs[at:end]), np.int64, end - at)
        if size <= 2 * GROUP_BYTES - 4 * WINDOW:
            a = np.frombuffer(b"".join(blobs[at:end]), np.uint8)
            places = _select(a, lengths, rank_of)
            owners.append(at + np.searchsorted(np.cumsum(lengths), places, side="right"))
            hashes.append(_hashes(a, places))
        else:  # one long text, in pieces that overlap by what the choice of a window depends on
            data = np.frombuffer(blobs[at], np.uint8)
            for begin in range(0, len(data), GROUP_BYTES):
                low = max(0, begin - 2 * WINDOW)
                part = data[low : begin + GROUP_BYTES + 4 * WINDOW]
                places = _select(part, np.array([len(part)]), rank_of)
                places = places[(places + low >= begin) & (places + low < begin + GROUP_BYTES)]
                owners.append(np.full(len(places), at))
                hashes.append(_hashes(part, places))
        at = end
    owner, h = np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])
    short = np.fromiter((len(b) < SHORT for b in blobs), bool, len(blobs))
    owner, h = owner[~short[owner]], h[~short[owner]]
    bare = [i for i in np.flatnonzero(np.bincount(owner, minlength=len(blobs)) == 0).tolist() if blobs[i]]
    if bare:
        whole = lambda blob: np.array([int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little")], np.uint64)
        own = [_short_hashes(blobs[i]) if short[i] else whole(blobs[i]) for i in bare]
        owner, h = np.append(owner, np.repeat(bare, [len(x) for x in own])), np.concatenate([h, *own])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return owner, h


def digests(blobs: list[bytes], rank_of: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text: an array (filters, 32) of 64-bit words."""
    return _filters(*features(blobs, rank_of), len(blobs))


def _filters(owner: np.ndarray, h: np.ndarray, n_texts: int) -> list[np.ndarray]:
    n = np.bincount(owner, minlength=n_texts)
    n_filters = -(-n // FILTER_FEATURES)
    first = np.cumsum(n_filters) - n_filters
    nth = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    base = (first[owner] + nth // FILTER_FEATURES) * FILTER_BITS
    bits = np.zeros(int(n_filters.sum()) * FILTER_BITS, bool)
    for k in range(FEATURE_BITS):
        bits[base + ((h >> np.uint64(11 * k + 4)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    words = np.packbits(bits).view(np.uint64).reshape(-1, FILTER_BITS // 64)
    return np.split(words, (first + n_filters)[:-1]) if n_texts else []


def comparable(a: bytes, own: np.ndarray, b: bytes, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests by which two texts compare: their own, or both by short windows if only one of them is short."""
    if 0 < min(len(a), len(b)) < SHORT <= max(len(a), len(b)) <= COMPARED:
        x, y = _short_hashes(a), _short_hashes(b)
        own, other = _filters(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
    return own, other


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """0 to 1 for each pair of digests. Each filter of the shorter one takes its best match in the other; filters weigh by their
    bits. Two empty digests are alike (1), an empty one is unlike all others (0)."""
    out = np.zeros(len(pairs))
    at = 0
    while at < len(pairs):
        end, size = at, 0
        while end < len(pairs) and (end == at or size < 20_000):
            size += len(pairs[end][0]) * len(pairs[end][1])
            end += 1
        out[at:end] = _likeness(pairs[at:end]) if end > at + 1 or size <= 100_000 else [_long_likeness(*pairs[at])]
        at = end
    return out


def _overlap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nx, ny = np.bitwise_count(x).sum(-1, dtype=float), np.bitwise_count(y).sum(-1, dtype=float)
    chance = nx * ny / FILTER_BITS
    return np.clip((np.bitwise_count(x & y).sum(-1) - chance) / np.maximum(np.minimum(nx, ny) - chance, 1e-9), 0, 1), nx


def _long_likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    weights = np.bitwise_count(a).sum(-1, dtype=float)
    return float(np.average([_overlap(x[None], b)[0].max() for x in a], weights=weights))


def _likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    na = np.array([len(a) for a, _ in short], np.int64)
    nb = np.array([len(b) for _, b in short], np.int64)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    live = np.flatnonzero((na > 0) & (nb > 0))
    if not len(live):
        return out
    left = np.concatenate([short[i][0] for i in live])
    right = np.concatenate([short[i][1] for i in live])
    rows_of = np.repeat(np.arange(len(live)), na[live])  # the pair of each left filter
    per_row = nb[live][rows_of]
    row = np.repeat(np.arange(len(left)), per_row)
    begin = np.cumsum(per_row) - per_row
    col = np.arange(len(row)) - begin[row] + (np.cumsum(nb[live]) - nb[live])[rows_of[row]]
    match, _ = _overlap(left[row], right[col])
    best, weight = np.maximum.reduceat(match, begin), np.bitwise_count(left).sum(-1, dtype=float)
    out[live] = np.bincount(rows_of, best * weight) / np.bincount(rows_of, weight)
    return out


def written(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def read_digest(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint64).reshape(-1, FILTER_BITS // 64)


def corpus_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks from the windows of all texts: every partition sends its counts, 1001 at most."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in sliced(batch, 8_000_000):
                total += window_levels([(t or "").encode() for t in part.column(0).to_pylist()])
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(total[level])], names=["level", "n"])

    rows = docs.select(text_col).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r.level] = r.n
    return rarity(counts)


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _keys_of_partitions(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions an integer that Spark's hash partitioning sends there."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
    found = spark.range(40 * n).groupBy(place).agg(F.min("id").alias("id")).collect()  # n rows
    keys = np.arange(n)
    for r in found:
        keys[r.place] = r.id
    return keys


def with_next(rows: DataFrame, rows_per_bucket: int = 6000, most_buckets: int = 1 << 16) -> DataFrame:
    """Deal (doc_id, text) out by ranges of ids, in order, a partition each, with the first row of each range once more behind the
    range before it (bucket, tail, doc_id, text). Texts move once. Only the ranges' ends, most_buckets at most, reach the driver."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = rows.count()
    buckets = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    cuts = np.array(sorted(set(rows.select(F.percentile_approx(key, [k / buckets for k in range(1, buckets)] or [0.5], 100_000)).first()[0] or [])), np.int64) if n else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def bucket_of(k):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="left").astype(np.int32))

    ids = rows.select(key.alias("k")).withColumn("bucket", bucket_of("k")).groupBy("bucket").agg(F.min("k").alias("k")).collect()
    heads = sorted((r.bucket, r.k) for r in ids)
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # the first id of a range: the range before it

    @F.pandas_udf("int")
    def tail_of(k):
        import pandas as pd

        return k.map(before).fillna(-1).astype(np.int32) if before else pd.Series(np.full(len(k), -1, np.int32))

    own_key = _keys_of_partitions(rows.sparkSession, len(cuts) + 1)

    @F.pandas_udf("int")
    def dealt_to(bucket):
        import pandas as pd

        return pd.Series(own_key[bucket.to_numpy()].astype(np.int32))

    keyed = rows.withColumn("k", key).withColumn("own", bucket_of("k")).withColumn("tail_bucket", tail_of("k"))
    both = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.col("tail_bucket").alias("bucket"), F.lit(1).alias("tail")))
    dealt = keyed.select("doc_id", "text", "k", F.explode(F.filter(both, lambda b: b["bucket"] >= 0)).alias("b")).select("b.bucket", "b.tail", "doc_id", "k", "text")
    return dealt.withColumn("deal", dealt_to("bucket")).repartition(len(cuts) + 1, "deal").sortWithinPartitions("bucket", "tail", "k", "text").drop("k", "deal")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: see SCHEMA. The next document is the one with the next larger id, after the last the first; rows
    that share an id follow each other in order of their texts, and a null id comes first. Null texts are empty; an empty text
    has the empty fingerprint."""
    rows = in_batches(id_and_text(docs, id_col, text_col))
    rank_of = corpus_rarity(rows)

    def finish(ids: list, texts: list[str], known: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        """All but the last, which is only the next of the one before it; and its digest."""
        changed = [edited(t, u).encode() for t, u in zip(texts, texts[1:], strict=False)]
        blobs = [t.encode() for t in texts]
        own = digests(blobs[known is not None :], rank_of)
        own = own if known is None else [known, *own]
        theirs = digests(changed, rank_of)
        near = likeness([*map(comparable, blobs, own, changed, theirs), *map(comparable, blobs, own, blobs[1:], own[1:])])
        m = len(changed)
        columns = [pa.array(ids[:m], pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string())]
        columns += [pa.array(map(written, own[:m]), pa.string()), pa.array(map(written, theirs), pa.string()), pa.array(near[:m]), pa.array(near[m:])]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")]), own[-1]

    return _over_pairs(rows, finish, SCHEMA)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256 as fingerprint() gives them, without the fingerprints."""

    def finish(ids: list, texts: list[str], known: None) -> tuple[pa.RecordBatch, None]:
        m = len(texts) - 1
        changed = [hashlib.sha256(edited(t, u).encode()).hexdigest() for t, u in zip(texts, texts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(ids[:m], pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()), pa.array(changed, pa.string())], names=["doc_id", "n_chars", "edited_sha256"]), None

    return _over_pairs(in_batches(id_and_text(docs, id_col, text_col)), finish, "doc_id long, n_chars long, edited_sha256 string")


def _over_pairs(rows: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(ids, texts, known) over slices of the ordered rows, each of which begins with the last row of the one before it; known is
    what finish found out about that row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, over, size, known = None, False, 0, None
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for b, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                if b != bucket:
                    bucket, over, size, known = b, False, 0, None
                    ids, texts = [], []
                if over:
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                over = bool(tail)
                if over or size > GROUP_BYTES and len(texts) > 1:
                    out, known = finish(ids, texts, known)
                    yield out
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return with_next(rows).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir, "documents"))


def edits_query(spark, sf_dir: str) -> DataFrame:
    """The columns of query() that SQL can express."""
    return edits(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, lead(coalesce(text, '')) OVER w AS u, first_value(coalesce(text, '')) OVER w AS f FROM documents WINDOW w AS (ORDER BY doc_id))
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 2) || left(coalesce(u, f), n // 2)) AS edited_sha256 FROM d
"""
