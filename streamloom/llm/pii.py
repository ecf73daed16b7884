"""Personal data by weak supervision. Built-in functions only on the rows.

Candidate spans come from strict patterns (the base, which always stays) and from looser ones. On each candidate labelers
vote: a validity check, a gazetteer, the words before the span, and its borders. Expectation-maximisation over the counts of
vote patterns (at most KINDS x 2^4 rows, whatever the data) estimates how reliable the labelers are; a logistic span
classifier is then trained on the posteriors and decides which further spans are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import id_and_text, read, settle

KINDS = ("email", "ip", "card", "phone")
VOTES = ("valid", "listed", "said", "apart")
ACCEPT = 0.9
CONTEXT = 32
CHUNK = 256

# The base patterns, written so that a long run of characters is scanned once: a match starts where a run starts (or where the
# match before ended), and runs are possessive. Each equals the plain pattern's leftmost matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"\x20?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\{dot\})\x20?"
_GAP = r"(?:[._/\x{A0}\x{2013}]|\x20{2}|\x20-\x20)"
#: Looser forms: obfuscated addresses, card numbers with other separators, national phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": rf"(?<![0-9])[0-9]{{4}}(?:(?:{_GAP}[0-9]{{4}}){{3}}|{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![0-9+(][\x20().-]{0,2})(?<![0-9A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: Words that announce each kind, and common endings of mail domains.
SAID = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|payment|credit|debit)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell)\b",
}
#: Fixed values, the gazetteers: endings of mail domains, well-known networks, card issuers' prefixes, country calling codes, and
#: area codes and exchanges of the North American plan.
LISTED = {
    "email": r"(?i)[.)\]}>\x20](com|org|net|edu|gov|mil|int|io|info|biz|name|dev|app|ai|co|me|tv|de|fr|es|uk|eu|us|it|nl|be|ch|at|pl|se|no|dk|fi|pt|ie|cz|gr|hu|ro|ru|ua|tr|jp|cn|kr|in|au|nz|ca|br|mx|ar|za)$",
    "ip": r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|8\.8\.8\.8$|8\.8\.4\.4$|1\.1\.1\.1$|1\.0\.0\.1$|9\.9\.9\.9$|208\.67\.22[02]\.22[02]$)",
    "card": r"^(4|5[0-8]|6[0-9]|3[0-9]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720))",
    "phone": r"^(\+(1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9])|[2-9][0-8][0-9][2-9])",
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda n, d: n + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_replace(value, "[^0-9]+", ".").rlike(_OCTETS)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array of integers, what joins all before it. Chunks are run through and then joined, as every append copies
    what it appends to: n values cost n * CHUNK / 2 + (n / CHUNK)^2 / 2 copies of small things."""
    none = F.array().cast("array<int>")

    def within(chunk: Column) -> Column:
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(chunk, F.struct(F.lit(zero).alias("at"), none.alias("out")), step)

    def across(s: Column, c: Column) -> Column:
        return F.struct(join(s["at"], c["at"]).alias("at"), F.array_append(s["out"], F.transform(c["out"], lambda x: join(s["at"], x))).alias("out"))

    def body(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda i: within(F.slice(v, i * CHUNK + 1, F.lit(CHUNK))))
        begin = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.when(F.size(v) == 0, none).otherwise(F.flatten(F.aggregate(chunks, begin, across, lambda s: s["out"])))

    return _bound(values, body)


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value, before, after) of every match, in code points, end exclusive; before and after are up to CONTEXT
    characters and one character of the text between this match and its neighbours. Starts add up matches and what is between."""

    def body(found: Column) -> Column:
        values, pieces = found["values"], found["pieces"]
        befores = F.slice(pieces, F.lit(1), F.size(values))
        ends = running(F.zip_with(befores, values, lambda a, b: F.char_length(a) + F.char_length(b)), lambda x, y: x + y, 0)
        each = F.arrays_zip(ends.alias("at"), befores.alias("before"), values.alias("value"), F.slice(pieces, F.lit(2), F.size(values)).alias("after"))

        def span(m: Column) -> Column:
            start = m["at"] + F.char_length(m["before"])
            return F.struct(start.alias("start"), (start + F.char_length(m["value"])).alias("end"), m["value"].alias("value"), F.right(m["before"], F.lit(CONTEXT)).alias("before"), F.left(m["after"], F.lit(1)).alias("after"))

        return F.when(F.size(values) > 0, F.transform(each, span)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>"))

    return _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("pieces")), body)


def free_of(loose: Column, base: Column) -> Column:
    """The spans of loose that overlap none of base. With all base starts and loose ends in order, the largest end of the base
    spans that start before a loose span's end tells."""

    def body(s: Column) -> Column:
        starts = F.transform(s["base"], lambda b: F.struct(b["start"].alias("key"), F.lit(1).alias("late"), b["end"].alias("end"), F.lit(-1).alias("nth")))
        ends = F.transform(s["loose"], lambda x, i: F.struct(x["end"].alias("key"), F.lit(0).alias("late"), F.lit(-1).alias("end"), i.alias("nth")))
        return _bound(F.sort_array(F.concat(starts, ends)), lambda events: free(s, events))

    def free(s: Column, events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["end"]), F.greatest, -1)
        each = F.zip_with(events, reach, lambda e, r: F.when((e["late"] == 0) & (r <= F.get(s["loose"], e["nth"])["start"]), e["nth"]))
        return F.transform(F.filter(each, lambda n: n.isNotNull()), lambda n: F.get(s["loose"], n))

    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(_bound(F.struct(loose.alias("loose"), base.alias("base")), body))


_MAY = {  # cheap tests that a text without them has no match
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_MAY_LOOSE = {
    "email": lambda t: t.rlike(r"at[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9]\x20?[\[({](?:\.|dot)[\])}]"),
    "card": lambda t: t.rlike(rf"[0-9]{{4}}{_GAP}[0-9]{{4}}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
_SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,valid:int,listed:int,said:int,apart:int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: every candidate of every row with its votes (1 or 0); kind is the place in KINDS."""
    rows = id_and_text(docs, id_col, text_col)
    text, found = F.col("text"), []

    def passes(kind: str):
        return lambda m: valid(kind, m["value"])

    def voted(kind: str, base: bool):
        def vote(m: Column) -> Column:
            name = {"card": _digits, "phone": lambda v: F.regexp_replace(v, "[^+0-9]", ""), "ip": lambda v: F.regexp_replace(v, "[^0-9]+", "."), "email": lambda v: v}[kind](m["value"])
            # a match right behind or before another one has one of its characters beside it
            apart = ~F.concat(F.when((m["before"] == "") & (m["start"] > 0), F.lit("_")).otherwise(F.right(m["before"], F.lit(1))), m["after"]).rlike(r"[0-9A-Za-z_]")
            one = lambda c: c.cast("int")
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), one(valid(kind, m["value"])).alias("valid"), one(name.rlike(LISTED[kind])).alias("listed"), one(m["before"].rlike(SAID[kind])).alias("said"), one(apart).alias("apart"))

        return vote

    for patterns, may, base in ((BASE, _MAY, True), (LOOSE, _MAY_LOOSE, False)):
        for kind, pattern in patterns.items():
            hits = F.filter(spans(text, pattern), passes(kind)) if base else spans(text, pattern)
            found.append(F.when(may[kind](text), F.transform(hits, voted(kind, base))).otherwise(F.array().cast(_SPAN)))
    return rows.select("doc_id", F.concat(*(f.cast(_SPAN) for f in found)).alias("spans"))


def reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over (votes, count): the share of true spans, P(vote | true) and P(vote | false) of each
    labeler, and the posterior of each pattern. Counts are smoothed; no patterns give the starting values."""
    n_votes = len(VOTES) + 1
    prior, rates = 0.5, [(0.8, 0.3)] * n_votes
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _n in patterns:
            up, down = math.log(prior), math.log(1 - prior)
            for v, (p, q) in zip(votes, rates, strict=True):
                up += math.log(p if v else 1 - p)
                down += math.log(q if v else 1 - q)
            post.append(1 / (1 + math.exp(max(-700.0, min(700.0, down - up)))))
        true = sum(n * w for (_, n), w in zip(patterns, post, strict=True))
        total = sum(n for _, n in patterns)
        prior = (true + 1) / (total + 2)
        rates = []
        for k in range(n_votes):
            hit = sum(n * w for (v, n), w in zip(patterns, post, strict=True) if v[k])
            miss = sum(n * (1 - w) for (v, n), w in zip(patterns, post, strict=True) if v[k])
            rates.append(((hit + 4) / (true + 5), (miss + 1.5) / (total - true + 5)))
    return prior, rates, post


def span_classifier(patterns: list[tuple[tuple, int]], post: list[float], rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights (one per vote, then the constant), trained on the posteriors, a pattern weighing log(1 + count)."""
    weights = [0.0] * (len(VOTES) + 2)
    mass = sum(math.log1p(n) for _, n in patterns) or 1.0
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for (votes, n), y in zip(patterns, post, strict=True):
            x = (*votes, 1)
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
            for k, v in enumerate(x):
                slope[k] += math.log1p(n) / mass * (p - y) * v
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def decide(found: DataFrame) -> DataFrame:
    """doc_id, base, added: the base spans, and the further ones that the span classifier accepts.

    A loose span votes 0 as the strict pattern's labeler. It is added if the classifier gives it ACCEPT or more and it
    overlaps no base span."""
    votes = (*VOTES, "base")
    each = found.select(F.explode("spans").alias("s")).select(*(F.col(f"s.{v}").cast("int").alias(v) for v in votes))
    counted = each.groupBy(*votes).count().orderBy(*votes).collect()  # 2^5 rows at most
    patterns = [(tuple(r[v] for v in votes), r["count"]) for r in counted]
    _, _, post = reliabilities(patterns)
    weights = span_classifier(patterns, post)

    def accepted(s: Column) -> Column:
        total = F.lit(weights[-1])
        for w, v in zip(weights, votes, strict=False):
            total = total + F.lit(w) * s[v].cast("int")
        return 1 / (1 + F.exp(-total)) >= ACCEPT

    base, loose = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: ~s["base"] & accepted(s))
    return found.select("doc_id", base.alias("base"), free_of(loose, base).alias("added"))


def _written(found: Column) -> Column:
    keys = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(keys, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added of every row (arrays of spans). The candidates are settled, so texts are read once."""
    return decide(settle(candidates(docs, id_col, text_col), "pii-candidates"))


def _base_columns() -> list[Column]:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return [F.col("doc_id"), *map(count, KINDS), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256")]


def query(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    return found.select(*_base_columns(), _written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base columns of query(), which SQL can express."""
    return find(read(spark, sf_dir, "documents")).select(*_base_columns())


def _sql_kind(kind: str, nth: int, pattern: str, passes: str) -> str:
    return f"""SELECT doc_id, {nth} AS k, '{kind}' AS kind, s + len(before) AS s, s + len(before) + len(v) AS e FROM (
      SELECT *, coalesce(sum(len(before) + len(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
        SELECT doc_id, unnest(range(len(vs))) AS i, unnest(vs) AS v, unnest(ps[:len(vs)]) AS before
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS vs, regexp_split_to_array(t, '{pattern}') AS ps FROM d))) WHERE {passes}"""


_SQL_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""list_sum(list_transform(range(1, len({_SQL_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_SQL_DIGITS})[i] AS INT)
  ELSE (CAST(reverse({_SQL_DIGITS})[i] AS INT) * 2) // 10 + (CAST(reverse({_SQL_DIGITS})[i] AS INT) * 2) % 10 END)) % 10 = 0"""
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_SQL_DIGITS}) BETWEEN 12 AND 19 AND {_SQL_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_SQL_DIGITS}) BETWEEN 9 AND 15"),
)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(kind, n, pattern, passes) for n, (kind, pattern, passes) in enumerate(_SQL_KINDS))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS w FROM m GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(w, '')) AS base_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
