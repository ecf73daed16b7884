"""Exact de-duplication: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Built-in functions only. The bytes take part in the grouping key itself: rows are pre-aggregated by (hash, text) before the
shuffle, so a group of copies, however large, sends one row per input partition, and two texts that share a hash stay apart.
Rows then meet their group by its two digests; those of the largest groups are dealt out to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import ascii_lower, fresh, hot_keys, id_and_text, read, settle, spread_join, total_order


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so all nulls and empty texts form one group.
    keep: "min" or "max", which id of a group stays. A group whose ids are all null keeps none. Of rows that repeat the
    staying id as well, exactly one is marked kept. Ids, not row order, break all ties.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = id_and_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm")).select("doc_id", "norm", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"))
    key = F.concat("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).alias("key")
    groups = settle(rows.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(key, "keep_id", "group_size"), "dedup-groups")
    members = rows.select("doc_id", key).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("key")))
    joined = spread_join(members, groups, "key", "doc_id", hot_keys(groups, "key", "group_size"))
    kept = F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("nth") == 1), F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("key", 17, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of equal texts, also of a group without ids.

    Rows are dealt out by hash and text, each partition having first left one row of a group, so texts move once and a large
    group sends a row per partition. Of rows that share the staying id, the other columns decide, and the text before lower-casing.
    """
    norm, digest, nth = fresh(docs, "norm", "digest", "nth")
    own = docs.withColumn(norm, ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    own = own.withColumn(digest, F.unhex(F.md5(F.col(norm).cast("binary"))))
    by_id = {"min": F.col(id_col).asc_nulls_last, "max": F.col(id_col).desc_nulls_last}[keep]()
    same = Window.partitionBy(digest, norm).orderBy(by_id, *total_order(docs))
    return own.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
