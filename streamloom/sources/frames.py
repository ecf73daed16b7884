"""Feed frames: JSON text to messages, with expressions only. raw frames are (pos, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions import numbers
from streamloom.operators.order import broadcast_if_small

_TIME = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?"
#: Bits of a position that count the samples of a frame: more than a string of 2^31 bytes can hold.
SAMPLE_BITS = 27


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Day number in the proleptic Gregorian calendar; days past a month's end roll over."""
    shifted = y * 12 + m - 3  # months since March of year 0
    year, month = F.floor(shifted / 12), F.pmod(shifted, F.lit(12))
    return (year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((month * 153 + 2) / 5) + d - 719469).cast("long")


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since the epoch, null if malformed. Zones are ignored, digits after the ninth too; month and day ranges
    are checked, nothing else."""
    part = lambda k: F.regexp_extract(text, _TIME, k).cast("long")
    ok = text.rlike(_TIME) & F.regexp_extract(text, _TIME, 2).between("01", "12") & F.regexp_extract(text, _TIME, 3).between("01", "31")
    fraction = F.rpad(F.substring(F.regexp_extract(text, _TIME, 7), 1, 9), 9, "0").cast("long")
    seconds = ((days_from_civil(part(1), part(2), part(3)) * 24 + part(4)) * 60 + part(5)) * 60 + part(6)
    return F.when(ok, seconds * 1_000_000_000 + fraction)


def decimal(text: Column) -> Column:
    """A string that strtod reads to its end, of less than 64 characters, as a double; null otherwise. White space may lead; hexadecimal,
    infinite and NaN forms count. Hexadecimal mantissas beyond 16 digits are refused."""
    body = F.regexp_replace(text, rf"\A{numbers.C_SPACE}", "")
    whole = lambda pattern: body.rlike(rf"\A(?:{pattern})\z")
    sign = F.when(body.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    part = lambda k: F.regexp_extract(body, r"\A[+-]?0[xX]0*([0-9A-Fa-f]*)\.?([0-9A-Fa-f]*)(?:[pP]([+-]?[0-9]+))?\z", k)
    mantissa, power = F.concat(part(1), part(2)), F.coalesce(F.when(part(3) != "", part(3)).try_cast("int"), F.lit(0)) - F.char_length(part(2)) * 4
    hexed = F.when(F.char_length(mantissa) <= 16, sign * F.coalesce(F.conv(F.when(mantissa != "", mantissa), 16, 10), F.lit("0")).cast("double") * F.pow(F.lit(2.0), power))
    value = F.when(whole(numbers.DECIMAL), body.try_cast("double")).when(whole(numbers.HEX), hexed)
    value = value.when(whole(numbers.INF), sign * F.lit(float("inf"))).when(whole(numbers.NAN), F.lit(float("nan")))
    return F.when(F.octet_length(text) < 64, value)


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    kind = _type(v, path)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, path, "double"))


def _unsigned(v: Column, path: str) -> Column:
    whole = F.when(_type(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(whole >= 0, whole)


def ticker_frames(frames: DataFrame, products: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """pos, parse_result (ok, heartbeat, skipped, malformed), stream_id, ts_ns, value, seq of push frames, and the columns to keep.
    products is (product_id, stream_id), one row per subscribed product."""
    v = F.col("v")
    f = frames.withColumn("v", F.try_parse_json("raw"))
    f = f.select("pos", *keep, _text(v, "$.type").alias("type"), _text(v, "$.product_id").alias("product_id"), decimal(_text(v, "$.price")).alias("value"), rfc3339_ns(_text(v, "$.time")).alias("ts_ns"), _unsigned(v, "$.trade_id").alias("trade"), _unsigned(v, "$.last_trade_id").alias("beat"))
    f = f.join(broadcast_if_small(products), "product_id", "left")
    tick, beat = F.col("type") == "ticker", F.col("type") == "heartbeat"
    result = F.when(F.col("type").isNull(), "malformed").when(~tick & ~beat, "skipped").when(F.col("product_id").isNull(), "malformed").when(F.col("stream_id").isNull(), "skipped")
    result = result.when(beat, F.when(F.col("beat").isNull(), "malformed").otherwise("heartbeat"))
    result = result.otherwise(F.when(F.col("value").isNull() | F.col("ts_ns").isNull() | F.col("trade").isNull(), "malformed").otherwise("ok"))
    f = f.withColumn("parse_result", result)
    ok, known = F.col("parse_result") == "ok", F.col("parse_result").isin("ok", "heartbeat")
    return f.select("pos", *keep, "parse_result", F.when(known, F.col("stream_id")).alias("stream_id"), F.when(ok, F.col("ts_ns")).alias("ts_ns"), F.when(ok, F.col("value")).alias("value"), F.when(ok, F.col("trade")).when(known, F.col("beat")).alias("seq"))


def grid_polls(frames: DataFrame, stream_id: int) -> DataFrame:
    """stream_id, ts_ns, value, pos of poll responses {"data": [{ts, value}]}; bad samples are left out one by one."""
    items = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("raw"), "$.data", "variant")), "array<variant>")
    f = frames.select("pos", F.posexplode(items).alias("k", "v"))
    f = f.select((F.shiftleft(F.col("pos"), SAMPLE_BITS) + F.col("k")).alias("pos"), rfc3339_ns(_text(F.col("v"), "$.ts")).alias("ts_ns"), _number(F.col("v"), "$.value").alias("value"))
    return f.filter("ts_ns IS NOT NULL AND value IS NOT NULL").select("pos", F.lit(stream_id).cast("long").alias("stream_id"), "ts_ns", "value")


def adsb_snapshots(frames: DataFrame, metric: str = "alt_baro") -> DataFrame:
    """hex, ts_ns, value, pos of aircraft that pass all tests; registration comes after, so bad ones take no place."""
    v = F.col("v")
    parsed = frames.select("pos", F.try_parse_json("raw").alias("v"))
    parsed = parsed.select("pos", _unsigned(v, "$.now").alias("now"), F.from_json(F.to_json(F.try_variant_get(v, "$.ac", "variant")), "array<variant>").alias("ac")).filter("now IS NOT NULL")
    f = parsed.select("pos", "now", F.posexplode("ac").alias("k", "v"))
    value = _number(v, f"$.{metric}")
    if metric == "alt_baro":
        value = F.when(_text(v, "$.alt_baro") == "ground", F.lit(0.0)).otherwise(value)
    seen = _number(v, "$.seen")
    f = f.select((F.shiftleft(F.col("pos"), SAMPLE_BITS) + F.col("k")).alias("pos"), _text(v, "$.hex").alias("hex"), _number(v, "$.lat").alias("lat"), _number(v, "$.lon").alias("lon"), (F.col("now") * 1_000_000 - (seen * F.lit(1e9)).cast("long")).alias("ts_ns"), value.alias("value"))
    return f.dropna().select("pos", "hex", "ts_ns", "value")


def read_labels(lines: DataFrame) -> DataFrame:
    """label_idx, stream_id, type, t_start_ns, t_end_ns of (label_idx, value) lines `id|type|start|end`; bad lines go."""
    p = F.split("value", r"\|", 4)
    f = lines.select("label_idx", F.size(p).alias("n"), F.get(p, F.lit(0)).try_cast("long").alias("stream_id"), F.get(p, F.lit(1)).alias("type"), F.get(p, F.lit(2)).try_cast("long").alias("t_start_ns"), F.get(p, F.lit(3)).try_cast("long").alias("t_end_ns"))
    return f.filter("n = 4 AND type IN ('spike', 'drift', 'stuck_at_value', 'dropout')").dropna().drop("n")
