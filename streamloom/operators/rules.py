"""Hard bounds and rate-of-change rules."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.numbers import strtod, u32
from streamloom.operators.order import broadcast_if_small, running

RULES = "stream_id long, min double, max double, max_rate_of_change double"


def rule_table(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """The rules of a list of configurations, of which the last of a stream holds."""
    last = {c["stream_id"]: c for c in configs}
    return spark.createDataFrame([(i, float(c["min"]), float(c["max"]), float(c["max_rate_of_change"])) for i, c in last.items()], RULES)


def check_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule_result: out_of_bounds, else rate_of_change when time advanced and the rate is larger, else ok. Streams
    without a rule are ok; of rules that repeat a stream, the one with the largest rule_idx holds (any one, if rules has no such
    column). Comparisons with NaN are false, as in the IEEE standard: a NaN is within all bounds."""
    rules = one_per_stream(rules)
    is_more = lambda a, b: (a > b) & ~F.isnan(a) & ~F.isnan(b)  # noqa: E731 - Spark has NaN above all numbers
    rate = F.abs(F.col("value") - F.col("prev")) / ((F.col("ts_ns") - F.col("prev_ts")).cast("double") / F.lit(1e9))
    m = running(messages, "before", F.struct("value", "ts_ns"), "last", keys=("stream_id",))
    m = m.withColumn("prev", F.col("before.value")).withColumn("prev_ts", F.col("before.ts_ns"))
    m = m.join(broadcast_if_small(rules), "stream_id", "left")
    result = F.when(is_more(F.col("min"), F.col("value")) | is_more(F.col("value"), F.col("max")), "out_of_bounds")
    result = result.when(F.col("prev_ts").isNotNull() & (F.col("ts_ns") > F.col("prev_ts")) & F.when(F.col("ts_ns") > F.col("prev_ts"), is_more(rate, F.col("max_rate_of_change"))), "rate_of_change")
    return m.withColumn("rule_result", result.otherwise("ok")).select(*messages.columns, "rule_result")


def one_per_stream(rules: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in RULES.split(", ")]
    if "rule_idx" not in rules.columns:
        return rules.select(*names).dropDuplicates(["stream_id"])
    last = rules.groupBy("stream_id").agg(F.max_by(F.struct(*names[1:]), "rule_idx").alias("r"))
    return last.select("stream_id", *(F.col(f"r.{n}").alias(n) for n in names[1:]))


def load_rule_config(path: str) -> dict:
    """A flat `key: value` file: stream_id, min, max and max_rate_of_change are required, others ignored, as are keys without a
    value; the last of a repeated key holds. Raises FileNotFoundError, or ValueError for a value that isn't wholly a number."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    kinds = {"stream_id": u32, "min": strtod, "max": strtod, "max_rate_of_change": strtod}
    out: dict = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, _, value = (x.strip(" \t\r\n") for x in line.split("#", 1)[0].partition(":"))
            if value and key in kinds:
                try:
                    out[key] = kinds[key](value)
                except ValueError as e:
                    raise ValueError(f"{path}: {key}: {e}") from e
    missing = [k for k in kinds if k not in out]
    if missing or out["min"] >= out["max"]:
        raise ValueError(f"{path}: " + (f"{missing[0]} is missing" if missing else "min isn't below max"))
    return {k: out[k] for k in kinds}
