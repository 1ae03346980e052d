"""Source tables: readers, checks before a snapshot, and change events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.model import Plan, RuleError

FORMATS = frozenset({"parquet", "orc", "json", "csv", "text"})


def read_table(spark: SparkSession, base: str, name: str, kind: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A table at base/name.kind."""
    if kind not in FORMATS:
        raise RuleError(f"format {kind} is not supported")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(f"{base}/{name}.{kind}")


def read_jdbc(spark: SparkSession, url: str, name: str, *, tls: str = "verify-full", **options) -> DataFrame:
    """A live table. TLS is verified unless it is switched off by name."""
    if tls not in ("verify-full", "disable"):
        raise RuleError("tls is verify-full or disable")
    return spark.read.format("jdbc").options(url=url, dbtable=name, sslmode=tls, **options).load()


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Change events as files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuleError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tributary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, until the session ends: its rows then hold for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary-settled-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def check_publication(plan: Plan, described: Mapping[str, Mapping]) -> None:
    """Fail closed unless a publication (table to {operations, omitted, row_filter, parent, via_root}) covers the plan."""
    needed = list(dict.fromkeys([*plan.sources(), *(x.table for x in plan.lookups())]))
    for table in needed:
        d = described.get(table)
        if d is None:
            raise RuleError(f"{table} is not published")
        missing = {"insert", "update", "delete", "truncate"} - set(d.get("operations", ()))
        if missing:
            raise RuleError(f"{table}: {min(missing)} is not published")
        for key, what in (("omitted", "omits columns"), ("row_filter", "filters rows"), ("parent", "is a partition or inheritance parent"), ("via_root", "is published via its root")):
            if d.get(key):
                raise RuleError(f"{table} {what}")


def check_start(start: int, durable: int | None, active: bool = False) -> None:
    """A source must begin where the stored state ends or before."""
    if active:
        raise RuleError("the source is in use")
    if durable is not None and start > durable:
        raise RuleError(f"the source begins at {start}, after the stored position {durable}")


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise RuleError(f"no column {c}")
