"""The four-layer pipeline: rules, moving baseline, CUSUM, conformal threshold; and questions about its alerts."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from streamloom.operators.fold import Profile, detect
from streamloom.operators.order import numbered, settle
from streamloom.operators.rules import check_rules, load_rule_config, rule_table
from streamloom.sources.trec import read_trec

LAYERS = {"feed": 0, "rules": 1, "cusum": 2, "conformal": 3}


def score_detail(z: float, threshold: float) -> str:
    return f"score={abs(z):.4f}>thr={threshold:.4f}"


@F.pandas_udf(StringType())
def _score_details(z: pd.Series, threshold: pd.Series) -> pd.Series:
    """By Python, which rounds as printf does; format_string rounds half up. Alerts alone come here."""
    return pd.Series(list(map(score_detail, z, threshold)), dtype="object")


def raised(messages: DataFrame, rules: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """pos, stream_id, ts_ns, layer, detail of all alerts, not numbered."""
    broken = F.when(F.col("rule_result") == "rate_of_change", "rate_violation").otherwise(F.col("rule_result"))
    ruled = check_rules(messages, rules).filter("rule_result <> 'ok'").select("pos", "stream_id", "ts_ns", F.lit("rules").alias("layer"), broken.alias("detail"))
    folded = detect(messages, profile).filter("cusum_fired OR anomalous").withColumn("score", _score_details("z", "threshold"))
    kinds = F.array(F.struct(F.lit("cusum").alias("layer"), F.lit("changepoint").alias("detail"), F.col("cusum_fired").alias("on")), F.struct(F.lit("conformal").alias("layer"), F.col("score").alias("detail"), F.col("anomalous").alias("on")))
    found = folded.select("pos", "stream_id", "ts_ns", F.explode(F.filter(kinds, lambda k: k["on"])).alias("k")).select("pos", "stream_id", "ts_ns", "k.layer", "k.detail")
    return ruled.unionByName(found)


def alerts(messages: DataFrame, rules: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """id, stream_id, ts_ns, layer, detail in order of arrival, then of layers."""
    return in_turn(raised(messages, rules, profile))


def in_turn(found: DataFrame) -> DataFrame:
    """Alerts that aren't numbered yet, with ids from 1. They are settled before."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kind in LAYERS.items() for x in kind)), F.col("layer"))
    return numbered(settle(found.withColumn("rank", rank)), "id", ties=("rank",)).select("id", "stream_id", "ts_ns", "layer", "detail")


def latest(found: DataFrame, limit: int = 100) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return found.orderBy(F.desc("id")).limit(limit)


def concurrent(found: DataFrame, ts_ns: int, window_ns: int) -> DataFrame:
    return found.filter(F.col("ts_ns").between(ts_ns - window_ns, ts_ns + window_ns)).orderBy("ts_ns", "id")


def window_slice(messages: DataFrame, stream_id: int, t0: int, t1: int) -> DataFrame:
    return messages.filter((F.col("stream_id") == stream_id) & F.col("ts_ns").between(t0, t1)).orderBy("pos").select("ts_ns", "value")


def stream_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("stream_id").agg(F.count(F.lit(1)).alias("processed"), F.max_by("ts_ns", "pos").alias("last_ts_ns"), F.max("seq").alias("last_seq"))


def status(messages: DataFrame, found: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row: messages, streams (sorted; those of the rules too), last time, alerts."""
    m = messages.agg(F.count(F.lit(1)).alias("processed"), F.collect_set("stream_id").alias("seen"), F.max_by("ts_ns", "pos").alias("last_ts_ns"))
    ruled = F.array().cast("array<bigint>") if rules is None else F.array(*(F.lit(r.stream_id).cast("long") for r in rules.select("stream_id").distinct().collect())).cast("array<bigint>")
    return one_row([m, found.agg(F.count(F.lit(1)).alias("alerts"))]).select("processed", F.array_sort(F.array_union("seen", ruled)).alias("streams"), "last_ts_ns", "alerts")


def one_row(rows: list[DataFrame]) -> DataFrame:
    """The columns of tables of one row each, side by side."""
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def run_file(spark: SparkSession, path: str, rule_files: list[str], profile: Profile = Profile()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The alerts and the status of a record file under the rules of some files."""
    messages, rules = read_trec(spark, path), rule_table(spark, [load_rule_config(f) for f in rule_files])
    found = settle(alerts(messages, rules, profile))
    return found, status(messages, found, rules)
