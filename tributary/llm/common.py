"""Helpers shared by the training-data operators.

Nothing here holds rows on the driver: intermediate tables are written to the
folder that the cluster shares, and only tables whose size has been measured
are broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 16 << 20
#: Python workers get Arrow batches of at most so many bytes.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tributary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tributary-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and its size is known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lowest(df: DataFrame, keys: list[Column], rows: int) -> list[Row]:
    """A sample of a fixed number of rows, for a fit: those whose keys hash lowest, in that order, fewer if there are
    not so many. The rows to be sorted are bounded first, by a hash that lets about twice the wanted number through."""
    hashed = df.withColumn("__low", F.pmod(F.xxhash64(*keys), F.lit(1 << 40)))
    n = df.count()
    bound = min(1 << 40, (rows * 2 << 40) // max(n, 1))
    return hashed.filter(F.col("__low") < bound).orderBy("__low", *keys).limit(rows).collect()  # at most `rows` rows


def size_of(df: DataFrame) -> int:
    """Bytes of a materialized table as rows in memory: eight a column and row, sixteen more for texts and arrays
    with their contents."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            parts.append(F.lit(24) + 8 * F.coalesce(F.size(f"`{f.name}`"), F.lit(0)))
        elif kind in ("string", "binary"):
            parts.append(F.lit(24) + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)))
        else:
            parts.append(F.lit(8 if kind != "struct" else 64))
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return df.agg(F.sum(total)).first()[0] or 0


def small(df: DataFrame) -> bool:
    """Whether a materialized table fits the broadcast bound, by the measured size of its rows."""
    return size_of(df) <= BROADCAST_BYTES


def attach(big: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table with a materialized one: broadcast if its measured size is within the bound, else a
    shuffled join, whose hot keys the adaptive planner splits (both sides are plain exchanges)."""
    return big.join(F.broadcast(table) if small(table) else table.hint("merge"), on, how)


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches sent to Python small, whatever the length of single texts."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash with a computed one."""
    return df.select(*names)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
