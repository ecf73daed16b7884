"""Mixing sources to target weights by Sainte-Lague apportionment. Built-in functions only.

1. Sizes (words) are summed by source; targets share the whole by weight, capped at MAX_REPEATS times a source's size, the
   excess reshared by weight (water filling).
2. Every source is cut into shards by a seeded hash of the id, so a hot source spreads over many tasks, and every shard, its
   documents in seeded order, into blocks of about BLOCK words (equal within a shard to one word).
3. Blocks to take are apportioned to sources, then to the shards of a source, by highest quotients v, v/3, v/5, ...: integer
   quotas. Only quotients near the cut are ranked; the seats below it are counted directly.
4. Within a shard a quota takes every block quota // blocks times, and once more those that a seeded affine permutation
   picks. A document takes its words in the blocks taken. The mix itself takes as many words once more, but whole documents in
   the shard's seeded order, so that no more than one of a shard is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import WORD, read, settle, total_order

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: A word and the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD
BLOCK = 8
SHARD_WORDS = 100_000
#: Beyond so many shards a source has as many as the root of its words, so that both a shard and the list of shards stay small.
MANY_SHARDS = 4096
SEED = 20_240_607


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Add weight and target to (source, source_size). Sources by code point, null last, take the weights in turn.

    With sources in the order of size / weight, a source is capped when all before it are and its cap is below its share of
    what those leave. The window runs over one row per source, not over documents.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1)
    t = totals.withColumn("nth", order).withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.col("left") / F.col("weight_left"))
    # The level of the first source that isn't capped holds for all after it.
    t = t.withColumn("place", F.row_number().over(by_ratio))
    t = t.withColumn("free", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))).over(whole))
    full = F.col("free").isNull() | (F.col("place") < F.col("free.place"))
    return t.select("source", "nth", "source_size", "weight", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("free.level"))).alias("target"), (full | (F.col("weight") * F.col("free.level") >= F.col("cap"))).alias("full"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """(group, party, won): `seats` (a column equal within a group) go to the highest quotients votes / (2k + 1), k from 0.

    Ties go to the smaller party. With n parties and divisor V / (S - n/2), rounding gives at most S seats in all, and with
    V / (S + n/2) at least S; so only the quotients between the two, 2n in all at most plus 2 for each rounding, are ranked.
    """
    g = Window.partitionBy(*group)
    p = parties.select(*group, party, F.col(votes).cast("double").alias("v"), F.col(seats).cast("double").alias("s")).filter("v > 0")
    p = p.withColumn("total", F.sum("v").over(g)).withColumn("n", F.count(F.lit(1)).over(g).cast("double"))
    seats_at = lambda s: F.greatest(F.floor(F.col("v") * s / F.col("total") + 0.5), F.lit(0)).cast("long")
    p = p.withColumn("low", seats_at(F.greatest(F.col("s") - F.col("n") / 2 - 1, F.lit(0.0)))).withColumn("high", seats_at(F.col("s") + F.col("n") / 2 + 1))
    p = p.withColumn("open", (F.col("s") - F.sum("low").over(g)).cast("long"))
    tried = p.filter("high > low").withColumn("k", F.explode(F.sequence("low", F.col("high") - 1)))
    by_quotient = Window.partitionBy(*group).orderBy((F.col("v") / (2 * F.col("k") + 1)).desc(), F.col(party), "k")
    won = tried.withColumn("rank", F.row_number().over(by_quotient)).filter("rank <= open")
    more = won.groupBy(*(F.col(c).alias(f"_{c}") for c in (*group, party))).agg(F.count(F.lit(1)).alias("more"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, party)]
    return p.join(more, same, "left").select(*group, party, (F.col("low") + F.coalesce("more", F.lit(0))).alias("won"))


def _coprime_step(blocks: Column, seed: Column) -> Column:
    """A step that is coprime to `blocks`: the first of some seeded primes larger than 2 that doesn't divide it."""
    primes = F.array(*(F.lit(p).cast("long") for p in (100_003, 99_991, 99_989, 99_971, 99_961, 99_929, 99_923, 99_907, 99_901, 99_881, 99_877, 99_871)))
    turned = F.concat(F.slice(primes, seed % 6 + 1, 12), F.slice(primes, F.lit(1), seed % 6 + 1))
    return F.get(F.filter(turned, lambda p: blocks % p != 0), F.lit(0))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Every row with doc_id, size, source_size, target, taken, and what it takes from: first (its first word's place in its
    shard), shard_size, blocks, each (times every block is taken), extra (blocks taken once more), step and turn.

    Null and empty texts have size 0 and take nothing; a source of size 0 has target 0. Rows that repeat an id are rows of
    their own, in order of size and then of a hash of the text. A null id is hashed as null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("key"))
    return mix_sizes(settle(rows, "mixing-sizes"), seed, block)


def mix_sizes(sizes: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    found = settle(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing-targets")
    n_shards = F.least(F.ceil(F.col("source_size") / SHARD_WORDS), F.greatest(F.lit(MANY_SHARDS), F.ceil(F.sqrt("source_size")))).cast("int")
    found = found.withColumn("n_shards", F.greatest(n_shards, F.lit(1)))
    joined = sizes.alias("a").join(found.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("doc_id", "size", "key", "nth", "source_size", "target", "full", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int").alias("shard"))
    shards = joined.groupBy("nth", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("full").alias("full"))
    shards = settle(shards.withColumn("blocks", F.when(F.col("shard_size") > 0, F.greatest(F.round(F.col("shard_size") / block), F.lit(1))).otherwise(0).cast("long")), "mixing-shards")
    # Seats of the sources that aren't capped; a capped source takes all its blocks MAX_REPEATS times.
    sources = shards.groupBy("nth").agg(F.sum("blocks").alias("blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("full").alias("full"))
    free = sources.filter("NOT full AND blocks > 0").withColumn("votes", F.col("target") / F.col("source_size") * F.col("blocks"))
    free = free.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy()))).withColumn("all", F.lit(0))
    quota = sainte_lague(free, ["all"], "nth", "votes", "seats").select("nth", F.col("won").alias("source_quota"))
    voted = shards.join(quota, "nth").filter("NOT full")
    won = sainte_lague(voted, ["nth"], "shard", "blocks", "source_quota").select("nth", "shard", "won")
    shards = shards.join(won, ["nth", "shard"], "left").withColumn("quota", F.when(F.col("full"), F.col("blocks") * MAX_REPEATS).otherwise(F.least(F.coalesce("won", F.lit(0)), F.col("blocks") * MAX_REPEATS)))
    turned = F.pmod(F.xxhash64(F.lit(seed + 1), "nth", "shard"), F.lit(1_000_003))
    shards = shards.select("nth", "shard", "shard_size", "blocks", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long").alias("each"), F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).cast("long").alias("extra"), turned.alias("turn"))
    shards = shards.withColumn("step", F.coalesce(_coprime_step(F.greatest("blocks", F.lit(1)), F.col("turn").cast("int")), F.lit(1).cast("long")))
    placed = joined.join(shards, ["nth", "shard"])
    own = Window.partitionBy("nth", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("first", F.sum("size").over(own) - F.col("size"))
    return placed.withColumn("taken", taken_words())


def block_edge(j: Column) -> Column:
    """The first word of block j of a shard."""
    return F.floor(j * F.col("shard_size") / F.col("blocks")).cast("long")


def is_extra(j: Column) -> Column:
    """Whether block j is among those taken once more: its place in the seeded permutation is below their number."""
    return (j * F.col("step") + F.col("turn")) % F.col("blocks") < F.col("extra")


def block_range() -> Column:
    """The blocks that a document's words touch (a block more at each end may be empty for it)."""
    low = F.floor(F.col("first") * F.col("blocks") / F.col("shard_size")).cast("long")
    high = F.floor((F.col("first") + F.col("size") - 1) * F.col("blocks") / F.col("shard_size")).cast("long")
    return F.sequence(F.greatest(low - 1, F.lit(0).cast("long")), F.least(high + 1, F.col("blocks") - 1))


def overlap(j: Column) -> Column:
    return F.greatest(F.least(block_edge(j + 1), F.col("first") + F.col("size")) - F.greatest(block_edge(j), F.col("first")), F.lit(0).cast("long"))


def taken_words() -> Column:
    more = F.aggregate(block_range(), F.lit(0).cast("long"), lambda n, j: n + F.when(is_extra(j), overlap(j)).otherwise(0))
    return F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("size") * F.col("each") + F.when(F.col("extra") > 0, more).otherwise(0))


def more_words() -> Column:
    """The words that a document gives once more to the mix itself: as many as the shard's extra blocks hold are taken from the
    shard's start, so whole documents in seeded order, and a part of one at most."""
    return F.when(F.col("extra") > 0, F.least(F.greatest(block_edge(F.col("extra")) - F.col("first"), F.lit(0).cast("long")), F.col("size"))).otherwise(0).cast("long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a document as often as all blocks of its shard are taken, and once more if it is
    among the first of its shard, whose words make up the blocks taken once more. Of the one document at the edge of those its
    first words, as they stand in the text. Documents that nothing is taken from go."""
    key = [F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.xxhash64(text_col).alias("_key")]
    plan = mix(docs, id_col, text_col, source_col, seed).withColumn("more", more_words()).filter("size * each + more > 0")
    names = settle(docs.select(F.col(source_col).cast("string").alias("_source")).distinct(), "mixing-names")
    nth = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    names = names.withColumn("nth", nth)
    # Rows of one id, source and text pair up in order: the plan's by place, the documents' by their other columns.
    plan = plan.join(names, "nth").withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "nth", "key").orderBy("first")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *key)
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_source", "_key").orderBy("_id", *total_order(docs.select([F.col(f"`{c}`") for c in docs.columns if c not in (id_col, source_col, text_col)]), "_row"))))
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("_source").alias("p_source"), F.col("key").alias("p_key"), F.col("_copy").alias("p_copy"), "size", "each", "more")
    met = rows.join(plan, F.col("_id").eqNullSafe(F.col("p_id")) & F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_key") == F.col("p_key")) & (F.col("_copy") == F.col("p_copy")))
    more, whole = F.col("more"), F.col("_row").getField(text_col)
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), more.cast("int")), "")
    rest = F.when((more > 0) & (more == F.col("size")), F.array(whole)).when(more > 0, F.array(part)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(whole, F.col("each").cast("int")), rest)
    made = met.withColumn("_text", F.explode(texts))
    changed = {text_col: F.col("_text"), chars_col: F.char_length("_text").cast("long")}
    return made.select(*(changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def targets_query(spark, sf_dir: str) -> DataFrame:
    """What every source has and should give, which SQL can express."""
    docs = read(spark, sf_dir, "documents")
    totals = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(words_in(F.col("text"))).alias("source_size"))
    return targets(totals).select("source", "source_size", "weight", F.floor(F.col("target") * 1000 + 0.5).cast("long").alias("target_milli"))


TARGETS_SQL = """
WITH RECURSIVE s AS (
  SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), w AS (
  SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(size) OVER () AS whole FROM s
), f AS (
  SELECT 0 AS round, source, size, weight, false AS capped, whole * weight / sum(weight) OVER () AS target FROM w
  UNION ALL
  SELECT round + 1, source, size, weight, over, CASE WHEN over THEN 3e0 * size
    ELSE ((SELECT any_value(whole) FROM w) - coalesce(sum(3e0 * size) FILTER (WHERE over) OVER (), 0)) * weight / sum(weight) FILTER (WHERE NOT over) OVER () END
  FROM (SELECT *, capped OR target > 3e0 * size AS over, bool_or(NOT capped AND target > 3e0 * size) OVER () AS more FROM f) WHERE more
)
SELECT source, size AS source_size, weight, CAST(floor(target * 1000 + 5e-1) AS BIGINT) AS target_milli FROM f WHERE round = (SELECT max(round) FROM f)
"""
