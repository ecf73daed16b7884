"""Pieces that several training-data operators share.

Conventions of every operator here: a null text counts as the empty text, a null id is an ordinary value that stays null,
repeated rows stay repeated, an empty table gives an empty result, and columns of the input other than the ones named are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOT, LEAST_HOT, SPREAD = 256, 1000, 64
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The white space of the split pattern of byte-level BPE (Unicode White_Space), for a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for shared intermediate tables; a local one only where none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="streamloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and survives lost executors. What was shuffled for it goes
    at once: else it stays on disk until the driver happens to collect its garbage, and a large job fills the disk."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, key: str, weight: str | None = None) -> list:
    """The keys that hold more than 1 / HOT of the rows (of the sum of weight), so fewer than HOT of them. rows should be settled."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    total = rows.agg(n.alias("n")).first().n or 0
    if total < LEAST_HOT:
        return []
    return [r[0] for r in rows.groupBy(key).agg(n.alias("_n")).filter(F.col("_n") * HOT > total).select(key).collect() if r[0] is not None]


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: list, how: str = "inner") -> DataFrame:
    """rows join table, which has one row per key. Rows of hot keys are dealt out by another column to SPREAD tasks, for which the
    table's rows of those few keys repeat."""
    if not hot:
        return rows.join(table, key, how)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_salt", salt).join(table.withColumn("_salt", salts), [key, "_salt"], how).drop("_salt")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A list of the tables that settle() writes from now on; those still in it at the end are removed, also after an error. What reads
    them must have run by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, a null text as the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() has a fast path for ASCII texts, on which both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_lower_py(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_TO_LOWER)


_TO_LOWER = str.maketrans(UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := name + "_" * k).lower() not in taken) for name in names]


def total_order(docs: DataFrame, inside: str | None = None) -> list[Column]:
    """An order of rows by all columns that have one (fields of the struct `inside`, if given): rows that tie are equal in them, so
    that it doesn't matter which comes first."""
    own = f"{inside}." if inside else ""
    return [F.col(f"{own}`{f.name}`").asc_nulls_last() for f in docs.schema.fields if not isinstance(f.dataType, MapType | VariantType)]


def in_batches(rows: DataFrame, most_rows: int = 1000) -> DataFrame:
    """Bound the Arrow batches that Python workers get, so that neither side of a worker holds a whole partition of texts.
    The bound holds for the session from then on; a size that the session sets itself stays."""
    conf = rows.sparkSession.conf
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in conf.getAll:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most_rows))
    return rows


def hash_sample(rows: DataFrame, n_rows: int, most: int, *columns: str) -> DataFrame:
    """At most `most` of n_rows rows: those with the smallest hashes of the first column, other columns breaking ties. A
    threshold on the hash leaves about 4 * most candidates before any are sorted."""
    key, space = F.pmod(F.xxhash64(columns[0]), F.lit(1 << 40)), 1 << 40
    limit = space if n_rows <= 8 * most else space * 4 * most // n_rows
    return rows.filter(key < limit).orderBy(key, *columns).limit(most)


def per_batch(rows: DataFrame, compute: Callable[..., dict], schema: str, columns: tuple[str, ...] = ("doc_id", "text"), keep: tuple[str, ...] = ("doc_id",), piece_chars: int = 8_000_000) -> DataFrame:
    """Apply compute(list, ...) -> {column: values} to slices of Arrow batches of bounded text size.

    compute gets the columns that aren't in keep as Python lists; columns in keep pass through unread.
    """
    taken = [c for c in columns if c not in keep]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for part in sliced(batch, piece_chars):
                out = compute(*(part.column(c).to_pylist() for c in taken))
                types = types or arrow_types(schema)
                yield pa.RecordBatch.from_arrays([part.column(c) if c in keep else pa.array(out[c], types[c]) for c in names], names=names)

    return in_batches(rows.select(*columns)).mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes each, a row at least."""
    if not batch.num_rows:
        return
    step = max(1, min(batch.num_rows, int(batch.num_rows * most // max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return {name: known[kind] for name, kind in (x.split() for x in schema.split(","))}


@lru_cache(maxsize=8)
def _long_run(least: int) -> re.Pattern:
    return re.compile(f"(?<![{WHITE}])[{WHITE}]{{{least},}}")


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut a long text into pieces of about `limit` characters where a non-space character meets a space, and each run of white
    space beyond `limit` apart.

    No match of the byte-level BPE split pattern crosses a place where a non-space meets a space, and its only look-ahead (a run of
    white space not followed by a non-space) starts after it, so pieces are tokenized as they are within the whole text. A run of
    white space is one match, less its last character if a non-space follows: that character begins the next piece.
    """
    if len(text) <= limit:
        return [text]
    pieces, at = [], 0
    for run in _long_run(limit + 2).finditer(text):
        end = run.end() - (run.end() < len(text))
        pieces += [*_cut(text[at : run.start()], limit), text[run.start() : end]]
        at = end
    return pieces + _cut(text[at:], limit)


def is_white(piece: str) -> bool:
    return re.fullmatch(f"[{WHITE}]+", piece) is not None


def _cut(text: str, limit: int) -> list[str]:
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        pieces.append(text[at : cut.start()])
        at = cut.start()
    return [*pieces, text[at:]] if at < len(text) else pieces
