"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(key: tuple, make):
    """make(), once per worker process and key: tasks that follow each other there share what is dear to build.

    Functions of this package are pickled by value, so a cache of their module would live for one task only.
    """
    held = sys.modules.setdefault("_quern_kept", types.ModuleType("_quern_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local runs may leave it unset and get a folder of this machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file://{tempfile.gettempdir()}/quern-shared"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}/{name}"


#: Spark 4.1 and later: an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned_up(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    release: the shuffle files of the write go as soon as the table is there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _cleaned_up(spark) if release else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 numbers up to which a set of numbers is broadcast whatever Spark's threshold is, about 100 MB.
WORDS = 2_000_000


def among(rows: DataFrame, numbers: DataFrame, how: str, of: Column | None = None) -> DataFrame:
    """The rows (left_semi), or the others (left_anti), whose number is among `numbers`, a table of one long column.

    of: the number in `rows`; by default the column of that name. The set is
    broadcast as bits, so wide rows are not shuffled; one of more than WORDS
    words is joined as Spark likes.
    """
    (name,) = numbers.columns
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    own, key = F.col(name) if of is None else of, F.col(f"`{name}`")
    words = numbers.groupBy(F.shiftright(key, 6).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    words = materialize(words, "words", release=True)
    words = F.broadcast(words) if words.count() <= WORDS else words
    return rows.join(words, (F.shiftright(own, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit(own)) != 0), how)


#: Tables up to this size are dealt out when they come in fewer files than there are cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt out to all cores if a small table comes in a few files, whose text work would keep only a few cores busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 0 < len(df.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SPREAD_BYTES:
        return df.repartition(cores)
    return df


#: Rows that one part of a numbering or a running sum gets on average, at most.
PART_ROWS = 1_000_000


def parts_for(df: DataFrame, least: int) -> int:
    """Parts to number the rows of a written table in: at least `least`, and more as it grows."""
    return max(least, df.count() // PART_ROWS)


def join_totals(rows: DataFrame, totals: DataFrame, key: str | list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join of rows to `totals`, a table aggregated by `key` (one column or several), in which hot keys can be split.

    A join by the aggregate's own key reads its shuffle below the aggregate, and
    adaptive execution leaves such a join whole. The second key, derived from
    the first, gives the totals a shuffle of their own, as long as they are too
    large to broadcast; then the rows of a hot key go to several tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    also = F.pmod(F.xxhash64(*keys), F.lit(2)).alias("_also")
    totals = totals.select("*", also)
    return rows.select("*", also).join(totals.hint(hint) if hint else totals, [*keys, "_also"], how).drop("_also")


def words_of(text: Column) -> Column:
    """Array of the maximal runs without SPACES."""
    return F.array_remove(F.split(text, SPACES_RE), "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8_buffers(column):
    """(bytes, starts, ends) of an Arrow string column as numpy arrays without copying; a null is empty."""
    import numpy as np
    import pyarrow as pa

    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        none = column.is_null().to_numpy(zero_copy_only=False)
        ends[none] = starts[none]
    return raw, starts, ends
