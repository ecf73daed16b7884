"""N-gram Jaccard self-join by a grouped prefix join.

Every document is the set of its distinct 5-word shingles (as 64-bit hashes). All shingles have one global order: by
the level of their document frequency in a sketch of fixed size, then by hash. Two sets of similarity 0.8
or more share a shingle among the first n - ceil(0.8 n) + 1 of each, their prefixes.

* Documents with equal sets form a class; classes with equal prefixes and sizes form a group. Both are told by 128-bit hashes, and
  then named by numbers of their own. Only groups, one row per prefix shingle, meet in the join, so copies cost nothing
  however many they are.
* First round: in every list of groups that share a shingle, each is paired only with the one that shares most with others
  over all its lists, a linear number of pairs. What verifies is linked, and components are built.
* Second round, which makes the result exact: pairs of groups that share a shingle and are not yet connected. Of each list
  only entries outside its most common component are paired with the others, so a cluster of near copies that is connected
  already makes no pairs among itself. Two sets that need an overlap of k share a shingle among the first n - k + 1 of each:
  only entries that early, for their two sizes, meet. Classes of one group that are still apart meet each other.
* A pair of groups is expanded to its members, and these are verified on their whole sets, if the number of prefix shingles
  they share allows the similarity (an exact bound).

Links inside a component that cannot change it are not enumerated; components are those of all links. Joins on keys that may be
hot (a class, a group, a shingle, the centre of a star of links, the label of a component) spread the few hottest keys over many tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import HOT, LEAST_HOT, hot_keys, id_and_text, in_batches, read, settle, sliced, spread_join, total_order

SHINGLE = 5
PERCENT = 80
SLOTS = 1 << 22
FILTER_WORDS = 1 << 21
CACHED = 20_000
FINE = 32
#: Sketch level from which a list counts as long: 2^8 deviations above what chance gives.
LONG_LIST = FINE + 8
_MULT = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED:
            self[word] = h
        return h


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one, one without words none."""
    words = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for own in words for h in map(_words.__getitem__, own)), np.uint64, int(counts.sum()))
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * _MULT + flat[k : len(flat) - size + 1 + k]
        rolled = _mixed(rolled)
        out, at = [], 0
        for n in counts.tolist():
            if n >= size:
                out.append(np.unique(rolled[at : at + n - size + 1]))
            elif n:
                h = np.uint64(n)
                for w in flat[at : at + n]:
                    h = h * _MULT + w
                out.append(_mixed(np.array([h], np.uint64) + _MULT))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def needed(n: int) -> int:
    """ceil(0.8 n): the least overlap that a set of n needs."""
    return -(-PERCENT * n // 100)


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """For each of SLOTS slots of shingle hashes, a level from 0 to 63 that rises with its count of documents: in quarters of the
    deviation that chance gives up to FINE, by its logarithm above. A set's prefix is from its emptiest slots, and a shingle
    has no more documents than its slot counts.

    Every partition counts into SLOTS counters; partial counters, a block in the fewest bytes that hold its largest, are added up block by
    block, in as many blocks as keep what one task adds up the same whatever the number of partitions. The order of shingles only affects speed: any order gives the same result."""
    n_tasks = 1 << max(6, min(16, (rows.rdd.getNumPartitions() // 8).bit_length()))
    n_blocks = min(16 * n_tasks, 1 << 16)  # so many that hashing deals them out evenly

    def count(batches):
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for part in sliced(batch, 1_000_000):
                found = np.concatenate(shingle_sets(part.column("text").to_pylist()))
                slots, n = np.unique(found & np.uint64(SLOTS - 1), return_counts=True)
                total[slots.astype(np.int64)] += n.astype(np.uint32)
        blocks = [b.astype(np.min_scalar_type(b.max())).tobytes() for b in np.split(total, n_blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, f"u{len(counts) * n_blocks // SLOTS}").astype(np.int64)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    found = settle(rows.select("text").mapInArrow(count, schema).repartition(n_tasks, "block").mapInArrow(add, schema), "ngram-sketch")
    total = np.zeros((n_blocks, SLOTS // n_blocks), np.uint32)
    for r in found.toLocalIterator():
        total[r.block] = np.frombuffer(r.counts, np.int64)
    load = total.mean()
    above = (total.ravel() - np.float32(load)) / np.float32(np.sqrt(max(load, 1)))
    fine = np.clip(FINE // 2 + 4 * above, 0, FINE)
    return np.minimum(fine + np.log2(np.maximum(above - FINE // 8 + 1, 1)), 63).astype(np.uint8)


def signatures(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """id, key (of the text), n, class (128-bit hash of the set), grp (of the prefix and size), prefix of every row."""

    def sign(batches):
        for batch in batches:
            for part in sliced(batch, 1_000_000):
                sets = shingle_sets(part.column("text").to_pylist())
                classes, groups, prefixes = [], [], []
                for s in sets:
                    level = levels[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                    keys = (level.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                    p = len(s) - needed(len(s)) + 1 if len(s) else 0
                    first = np.sort(np.partition(keys, p - 1)[:p] if p < len(s) else keys)
                    classes.append(_digest(s.tobytes()))
                    groups.append(_digest(first.tobytes() + len(s).to_bytes(8, "little")))
                    prefixes.append(first.view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "key", "n", "class", "grp", "prefix"],
                )

    return rows.mapInArrow(sign, "id long, key long, n long, class binary, grp binary, prefix array<long>")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _similar_sizes(a: Column, b: Column) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def _least_overlap(a: Column, b: Column) -> Column:
    """The least overlap that sets of a and b need for similarity 0.8, a whole number."""
    return F.floor(((a + b) * PERCENT + (99 + PERCENT)) / (100 + PERCENT)).cast("long")


def _may_link(shared: Column, a: Column, b: Column) -> Column:
    """Shared prefix shingles + the longer rest beyond a prefix reach the overlap that similarity 0.8 needs."""
    rest = F.ceil(F.greatest(a, b) * PERCENT / 100.0) - 1
    return shared + rest >= F.ceil((a + b) * (PERCENT / (100.0 + PERCENT)) - 1e-6)


def _filter_of(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n ids, built in the cluster, of 16 bits an id as far as FILTER_WORDS words (16 MB) allow: it only spares work,
    never decides."""
    n_words = min(FILTER_WORDS, 1 << max(10, (n // 4).bit_length()))
    bit = F.explode(F.array(*_bits_of(n_words)))
    words = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    out = np.zeros(n_words, np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out


def _bits_of(n_words: int) -> list[Column]:
    return [F.pmod(F.xxhash64("id", *x), F.lit(n_words * 64)) for x in ((), (F.lit(1),))]


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link. Sets are made again from the texts of the classes' first documents."""
    pairs = settle(pairs.select("a", "b").distinct(), "ngram-pairs")
    if pairs.isEmpty():
        return pairs
    wanted = settle(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi").select("cid", "class", "top.id"), "ngram-wanted")
    may = _filter_of(wanted.select("id"), wanted.count())
    b1, b2 = _bits_of(len(may))
    marked = rows.select("text", b1.alias("b1"), b2.alias("b2"))

    def make(batches):
        for batch in batches:
            b1, b2 = batch.column("b1").to_numpy(), batch.column("b2").to_numpy()
            hit = (may[b1 >> 6] >> (b1 & 63)) & (may[b2 >> 6] >> (b2 & 63)) & 1
            for part in sliced(batch.filter(pa.array(hit == 1)), 1_000_000):
                sets = shingle_sets(part.column("text").to_pylist())
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["class", "set"])

    sets = marked.mapInArrow(make, "class binary, set array<long>").join(wanted.select("class", "cid"), "class").groupBy("cid").agg(F.any_value("set").alias("set"))
    one = spread_join(pairs, sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b", "a", hot_keys(pairs, "b"))
    both = spread_join(one, sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a", "b", hot_keys(pairs, "a"))
    both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return settle(both.filter(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * PERCENT).select("a", "b"), "ngram-links")


def components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, comp, best) of every class that has a link: the class of its component with the smallest top, and that top. Smallest
    labels spread to neighbours, then every label is replaced by its own label, until nothing changes."""
    both = settle(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")).distinct(), "ngram-edges")
    own = F.struct("top", F.col("cid").alias("l")).alias("label")
    labels = settle(classes.join(both.select(F.col("v").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("v"), own), "ngram-labels")
    centres = hot_keys(both, "u")
    while not labels.isEmpty():
        near = spread_join(both, labels.select(F.col("v").alias("u"), "label"), "u", "v", centres).groupBy("v").agg(F.min("label").alias("near"))
        spread = labels.join(near, "v").select("v", F.col("label.l").alias("old"), F.least("label", "near").alias("label"))
        spread = settle(spread.withColumn("l", F.col("label.l")), "ngram-spread")
        jump = labels.select(F.col("v").alias("l"), F.col("label").alias("far"))
        new = settle(spread_join(spread, jump, "l", "v", hot_keys(spread, "l")).select("v", "old", F.least("label", "far").alias("label")), "ngram-labels")
        labels = new.select("v", "label")
        if new.filter("label.l <> old").isEmpty():
            break
    return labels.select(F.col("v").alias("cid"), F.col("label.l").alias("comp"), F.col("label.top").alias("best"))


def _shared_posts(posts: DataFrame) -> DataFrame:
    """Posts (token, grp, n, pos) of the tokens that more than one group has, with that number m.

    Lists of tokens that the sketch finds frequent can be long: these are counted by aggregation, so that no task gets a whole
    list; the others are counted by a window, in one shuffle."""
    columns = ("token", "grp", "n", "pos", "m")
    long_list = F.shiftrightunsigned("token", 58) >= LONG_LIST
    short = posts.filter(~long_list).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("m > 1")
    frequent = posts.filter(long_list)
    counts = settle(frequent.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "ngram-lists")
    return short.select(*columns).union(spread_join(frequent, counts, "token", "grp", hot_keys(counts, "token", "m")).select(*columns))


def _heads(posts: DataFrame) -> DataFrame:
    """token, head, head_n: of every list the group that shares most with others over all its lists. In a cluster of edited
    copies that is the least edited one, and most others link with it."""
    weights = posts.groupBy("grp").agg(F.sum("m").alias("w"))
    head = F.max(F.struct("w", "grp", "n")).alias("x")
    return posts.join(weights, "grp").groupBy("token").agg(head).select("token", F.col("x.grp").alias("head"), F.col("x.n").alias("head_n"))


def _with_enough_shared(met: DataFrame, signed: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (pg, qg) of groups whose whole prefixes share as much as similarity 0.8 needs."""
    ends = met.select(F.explode(F.array("pg", "qg")).alias("gid")).distinct()
    known = signed.join(firsts.join(ends, "gid", "left_semi"), "grp").groupBy("gid").agg(F.first("n").alias("n"), F.any_value("prefix").alias("prefix"))
    side = lambda s: known.select(F.col("gid").alias(f"{s}g"), F.col("n").alias(f"{s}n"), F.col("prefix").alias(f"{s}prefix"))
    pairs = spread_join(met, side("p"), "pg", "qg", hot_keys(met, "pg"))
    pairs = spread_join(pairs, side("q"), "qg", "pg", hot_keys(met, "qg"))
    return pairs.filter(_may_link(F.size(F.array_intersect("pprefix", "qprefix")), F.col("pn"), F.col("qn"))).select(*met.columns)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts have no shingles and link with nothing, not even with each other; their component is themselves. Rows
    that repeat a text are linked. A null id counts as the smallest.
    """
    signed, placed = _placed(plain_rows(docs, id_col, text_col), nulls_last=False)
    out = _of_classes(signed.select("id", "n", "class"), placed).select("id", "n", F.col("best.id").alias("component"))
    out = out.union(signed.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def _of_classes(signed: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows that have shingles, with what is known of their class."""
    return spread_join(signed.filter("n > 0"), placed.select("class", "best"), "class", "id", hot_keys(placed, "class", "rows"))


def _placed(rows: DataFrame, nulls_last: bool) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and every class (class, cid, rows, ...) with the component (comp) that it is in, and that component's
    first document (best: late, id, key). nulls_last: whether rows without an id come after all others."""
    signed = settle(signatures(rows, frequency_levels(rows)), "ngram-signatures")
    full = signed.filter("n > 0")
    late = F.col("id") == NO_ID if nulls_last else F.lit(False)
    classes = full.groupBy("class").agg(F.min(F.struct(late.alias("late"), "id", "key")).alias("top"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.count(F.lit(1)).alias("rows"))
    named = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-named")  # written once: the numbers stay
    firsts = settle(named.groupBy("grp").agg(F.min("cid").alias("gid")), "ngram-firsts")  # a group is named by its first class
    classes = settle(spread_join(named, firsts, "grp", "cid", hot_keys(named, "grp")).drop("grp"), "ngram-classes")
    groups = full.groupBy("grp").agg(F.first("n").alias("n"), F.any_value("prefix").alias("prefix")).join(firsts, "grp")
    posts = settle(_shared_posts(groups.select(F.col("gid").alias("grp"), "n", F.posexplode("prefix").alias("pos", "token"))), "ngram-posts")

    total = posts.count()
    long_lists = [r.token for r in posts.filter(F.col("m") * HOT > total).select("token").distinct().collect()] if total >= LEAST_HOT else []  # fewer than HOT
    starred = spread_join(posts, _heads(posts), "token", "grp", long_lists).filter((F.col("grp") != F.col("head")) & _similar_sizes(F.col("n"), F.col("head_n")))
    starred = starred.groupBy("head", "grp").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("head_n").alias("head_n"))
    starred = starred.filter(_may_link(F.col("shared"), F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("grp").alias("b"))
    within = classes.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    links = verified(starred.union(within), rows, classes)

    def in_components(links: DataFrame) -> DataFrame:
        known = classes.join(components(links, classes), "cid", "left")
        return settle(known.select("class", "cid", "n", "gid", "rows", F.coalesce("comp", "cid").alias("comp"), F.coalesce("best", "top").alias("best")), "ngram-placed")

    placed = in_components(links)
    parts = placed.select(F.col("gid").alias("grp"), "comp").distinct()
    split = settle(posts.select("token", "grp", "n", "pos").join(parts, "grp"), "ngram-split")
    apart = parts.groupBy("grp").count().filter("count > 1").select("grp")
    apart = settle(parts.join(apart, "grp"), "ngram-apart")
    if not (split.isEmpty() and apart.isEmpty()):
        # lists of more than one component, and the component that most of their entries are in
        main = split.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("n")).groupBy("token").agg(F.max(F.struct("count", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"), F.min("n").alias("least_n"))
        main = main.filter("comps > 1").select("token", F.col("x.comp").alias("main"), "least_n")
        split = spread_join(split, main, "token", "grp", long_lists).withColumn("minor", F.col("comp") != F.col("main"))
        # what isn't early enough for the smallest partner that its list may hold goes before any pairs are made
        smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * PERCENT / 100.0)).cast("long")
        split = split.filter(F.col("pos") <= F.col("n") - _least_overlap(F.col("n"), smallest))
        left, right = split.alias("x"), split.filter("minor").alias("y")
        order = ~F.col("x.minor") | (F.struct("x.grp", "x.comp") < F.struct("y.grp", "y.comp"))
        least = _least_overlap(F.col("x.n"), F.col("y.n"))
        early = (F.col("x.pos") <= F.col("x.n") - least) & (F.col("y.pos") <= F.col("y.n") - least)
        met = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.grp") != F.col("y.grp")) & (F.col("x.comp") != F.col("y.comp")) & order & _similar_sizes(F.col("x.n"), F.col("y.n")) & early)
        ends = [F.struct(F.col(f"{s}.grp").alias("grp"), F.col(f"{s}.comp").alias("comp")) for s in "xy"]
        met = met.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).distinct()
        met = settle(met.select(F.col("p.grp").alias("pg"), F.col("p.comp").alias("pc"), F.col("q.grp").alias("qg"), F.col("q.comp").alias("qc")), "ngram-met")
        own = apart.alias("x").join(apart.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.comp") < F.col("y.comp")))
        own = own.select(F.col("x.grp").alias("pg"), F.col("x.comp").alias("pc"), F.col("y.grp").alias("qg"), F.col("y.comp").alias("qc"))
        met = _with_enough_shared(met, full, firsts).union(own)
        member = lambda s, c: placed.select(F.col("cid").alias(c), F.col("gid").alias(f"{s}g"), F.col("comp").alias(f"{s}c"))
        more = met.join(member("p", "a"), ["pg", "pc"]).join(member("q", "b"), ["qg", "qc"])
        links2 = verified(more.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), rows, classes)
        if not links2.isEmpty():
            placed = in_components(links.union(links2))
    return signed, placed


def plain_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_batches(id_and_text(docs, id_col, text_col)).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("key"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: exactly one of each component, with the smallest id (a null id loses to
    any other). Rows are told apart by id and text, as ids may repeat. Rows without shingles stay."""
    signed, placed = _placed(plain_rows(docs, id_col, text_col), nulls_last=True)
    members = _of_classes(signed.select("id", "key", "n", "class"), placed)
    gone = members.filter("id <> best.id OR key <> best.key").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    again = settle(signed.filter("n > 0").groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).count().filter("count > 1"), "ngram-again")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(row, F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    kept = keyed.join(gone, ["_id", "_key"], "left_anti")
    if not again.isEmpty():
        same = Window.partitionBy("_id", "_key").orderBy("_id", *total_order(docs, "_row"))
        one = kept.join(again, ["_id", "_key"], "left_semi").withColumn("_nth", F.row_number().over(same)).filter("_nth = 1")
        kept = kept.join(again, ["_id", "_key"], "left_anti").unionByName(one.drop("_nth"))
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  WITH RECURSIVE r(v, u) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u
  ) SELECT v, min(u) AS u FROM r GROUP BY v
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.u AS component_id FROM n JOIN r ON r.v = n.doc_id
"""
