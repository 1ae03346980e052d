"""The store: generations of Parquet tables under numbered manifests.

A batch writes its tables into a new generation's folder and then its manifest
under the next number, which fails if another writer has taken that number; so
readers always see one whole state: documents, sums, log, position. A batch
that was delivered before is skipped by its position. Manifests are written
through Hadoop's file system, as Spark's tables are.

Current documents are laid out by a hash of their route into slots, with the
checkpoint sums of every bucket beside them. A batch rewrites only the slots
that its operations touch, and a request reads only the slots of its buckets.
Folders that no recent manifest names are deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cdc
from ..plans.model import RuleError

KEEP = 1_000_000
EPOCH = 1 << 20

CURRENT = T.StructType([T.StructField(n, T.StringType()) for n in ("object_type", "object_id", "data", "route")] + [T.StructField("op_id", T.LongType())])
TAIL = T.StructType([T.StructField("op_id", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("op", "object_type", "object_id", "data", "route", "previous_data", "previous_route")])
#: What operations that are no longer in the log have superseded, by route.
SUPERSEDED = T.StructType([T.StructField("bucket", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("count", "checksum")])


#: Count and checksum (unsigned) of the current documents of a bucket, and bytes of their documents and keys.
SUMS = T.StructType([T.StructField("bucket", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("count", "checksum", "bytes")])
SCHEMAS = {"current": CURRENT, "tail": TAIL, "superseded": SUPERSEDED, "sums": SUMS}
#: What the tables of lookup rows are called in manifests and folders, before their own name.
LOOKUP = "lookup-"
#: Slots of a new store, operations up to which their keys are broadcast, seconds that an old manifest is kept.
SLOTS, FEW, OLD_SECONDS = 64, 100_000, 900.0


class WriteConflict(RuleError):
    """Another writer has committed in between: the batch is to be applied to the new state."""


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    contract: str = ""
    source: str = ""
    last_lsn: int = -1
    last_op_id: int = 0
    snapshot_floor: int = 0
    retained_floor: int = 0
    complete: bool = False
    paths: Mapping[str, tuple[str, ...]] = None  # table to its folders; those of slots end in slot=N
    slots: int = SLOTS


def slot_of(bucket: str | None, slots: int) -> int:
    """The slot of a bucket; slot_column is the same for a column."""
    x = xxhash.xxh64_intdigest((bucket or "").encode(), 42)
    return (x - (1 << 64) if x >> 63 else x) % slots


def slot_column(route: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(route, F.lit(""))), F.lit(slots)).cast("int")


class Store:
    """One store at a URI. `route` columns hold the names of buckets."""

    def __init__(self, spark: SparkSession, uri: str, contract: str, source: str = "", keep: int = KEEP, slots: int = SLOTS, old_seconds: float = OLD_SECONDS, raw: bool = False):
        self.spark, self.uri, self.contract, self.source, self.keep = spark, uri.rstrip("/"), contract, source, keep
        self.slots, self.old_seconds, self.raw = slots, old_seconds, raw  # raw: batches are kept as they came
        self.counters = dict.fromkeys(("batches", "skipped_batches", "operations", "rewritten_slots", "conflicts", "deleted_folders"), 0)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(self._conf)

    # -- manifest ----------------------------------------------------------------------------------------------------

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, time of its change in seconds) of what is in a folder."""
        at = self._path(f"{self.uri}/{folder}" if folder else self.uri)
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read(self, name: str) -> Manifest:
        stream = self._fs.open(self._path(f"{self.uri}/manifests/{name}"))
        try:
            m = Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            return replace(m, paths={n: tuple(p) for n, p in (m.paths or {}).items()})
        finally:
            stream.close()

    def manifest(self) -> Manifest | None:
        """The newest manifest, read by the driver without a job."""
        names = [n for n, _ in self._listed("manifests") if n.endswith(".json")]
        return self._read(max(names)) if names else None

    def _commit(self, m: Manifest) -> Manifest:
        """Move a manifest to its number, which must be free."""
        temp = self._path(f"{self.uri}/manifests/{uuid.uuid4().hex}.temp")
        final = self._path(f"{self.uri}/manifests/{m.generation:020d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(final), options)
        except Exception as error:
            self._fs.delete(temp, False)
            if not self._fs.exists(final):
                raise
            self.counters["conflicts"] += 1
            raise WriteConflict(f"generation {m.generation} is another writer's") from error
        return m

    def prune(self) -> int:
        """Delete manifests older than old_seconds, but never the newest, and the folders that none left names; returns
        the number of folders. Readers pin a manifest for a shorter time than that."""
        found = sorted((n, t) for n, t in self._listed("manifests") if n.endswith(".json"))
        if not found:
            return 0
        limit = time.time() - self.old_seconds
        kept = [n for n, t in found[:-1] if t > limit] + [found[-1][0]]
        for n, _ in found:
            if n not in kept:
                self._fs.delete(self._path(f"{self.uri}/manifests/{n}"), False)
        named = {p[len(self.uri) + 1 :].split("/")[0] for n in kept for ps in (self._read(n).paths or {}).values() for p in ps}
        newest, gone = int(found[-1][0].split(".")[0]), 0
        for folder, changed in self._listed(""):
            # a folder beyond the newest generation may be a writer's that has not committed yet
            if folder.startswith("generation=") and folder not in named and changed < limit and int(folder[11:].split("-")[0]) <= newest:
                self._fs.delete(self._path(f"{self.uri}/{folder}"), True)
                gone += 1
        self.counters["deleted_folders"] += gone
        return gone

    # -- tables ------------------------------------------------------------------------------------------------------

    def _folder(self, generation: int) -> str:
        return f"{self.uri}/generation={generation}-{uuid.uuid4().hex[:8]}"

    def _write(self, df: DataFrame, name: str, folder: str) -> str:
        df.write.parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    def _write_slots(self, df: DataFrame, name: str, folder: str, route: str) -> tuple[str, ...]:
        """Write a table by slot; large slots are dealt to several tasks, small ones share one."""
        slotted = df.withColumn("slot", slot_column(F.col(route), self.slots))
        slotted.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{folder}/{name}")
        at = f"{folder}/{name}"
        return tuple(sorted(f"{at}/{n}" for n, _ in self._listed(at[len(self.uri) + 1 :]) if n.startswith("slot=")))

    def _read_paths(self, name: str, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str, m: Manifest | None = None, slots: set[int] | None = None) -> DataFrame:
        """A table of a pinned manifest (the present one if none is given), of some slots only if they are named."""
        m = m or self.manifest()
        paths = list((m.paths or {}).get(name, ())) if m else []
        return self._read_paths(name, [p for p in paths if slots is None or int(p.rsplit("slot=", 1)[1]) in slots])

    def current(self, names: Sequence[str], m: Manifest) -> DataFrame:
        """Current documents of the slots that hold these buckets."""
        return self.table("current", m, {slot_of(n, m.slots) for n in names})

    def sums(self, names: Sequence[str], m: Manifest) -> DataFrame:
        return self.table("sums", m, {slot_of(n, m.slots) for n in names})

    def lookup(self, table: str, m: Manifest | None = None) -> DataFrame | None:
        """The rows of a lookup's table that the store keeps, None if it keeps none."""
        m = m or self.manifest()
        paths = list((m.paths or {}).get(f"{LOOKUP}{table}", ())) if m else []
        return self.spark.read.parquet(*paths) if paths else None

    def lookups(self, m: Manifest | None = None) -> dict[str, DataFrame]:
        m = m or self.manifest()
        names = [n.removeprefix(LOOKUP) for n in (m.paths or {}) if n.startswith(LOOKUP)] if m else []
        return {n: self.lookup(n, m) for n in names}

    def _state(self, rows: DataFrame, folder: str) -> dict[str, tuple[str, ...]]:
        """Write documents and the sums of their buckets."""
        current = self._write_slots(rows.select(*CURRENT.names), "current", folder, "route")
        kept = self._read_paths("current", current)
        size = F.coalesce(F.octet_length("data"), F.lit(0)) + F.octet_length("object_type") + F.octet_length("object_id")
        checked = kept.select(F.col("route").alias("bucket"), cdc.put_checksum(F.col("object_type"), F.col("object_id"), F.col("data")).alias("checksum"), size.alias("bytes"))
        sums = checked.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), cdc.checksum_sum().alias("checksum"), F.sum("bytes").alias("bytes"))
        return {"current": current, "sums": self._write_slots(sums.select(*SUMS.names), "sums", folder, "bucket")}

    # -- writing -----------------------------------------------------------------------------------------------------

    def fits(self, m: Manifest | None) -> bool:
        """Whether a manifest is a finished store of this contract and source."""
        return m is not None and m.complete and m.contract == self.contract and m.source == self.source

    def open(self) -> Manifest | None:
        """The manifest, or None if the store has to be built: it is empty, unfinished, or of another contract or
        source. An unfinished build begins anew with operation ids that no earlier cursor has."""
        m = self.manifest()
        return m if self.fits(m) else None

    def snapshot(self, documents: DataFrame, lsn: int, lookups: Mapping[str, DataFrame] | None = None) -> Manifest:
        """Seed the store with documents (object_type, object_id, data, route) and rows (id, text columns) of lookup
        tables. Documents take operation ids but are not in the log; cursors from before are below the floor. That it
        has begun is committed first, so that an interrupted build is seen as unfinished."""
        old = self.manifest()
        base = max(old.last_op_id, int(time.time() * 1000) * EPOCH) if old else 0
        begun = self._commit(Manifest((old.generation if old else 0) + 1, self.contract, self.source, -1, base, base, base, False, {}, self.slots))
        rows = documents.withColumns({"lsn": F.lit(0), "seq": F.xxhash64("object_type", "object_id"), "sub": F.struct("object_type", "object_id")})
        generation = begun.generation + 1
        folder = self._folder(generation)
        paths = self._state(cdc.with_op_ids(rows, base), folder)
        paths |= {f"{LOOKUP}{n}": (self._write(df, f"{LOOKUP}{n}", folder),) for n, df in (lookups or {}).items()}
        last = base + self._read_paths("current", paths["current"]).count()
        return self._commit(replace(begun, generation=generation, last_lsn=lsn, last_op_id=last, snapshot_floor=last, retained_floor=last, complete=True, paths=paths | {"tail": ()}))

    def apply(self, changes: DataFrame, lookups: Mapping[str, DataFrame] | None = None) -> Manifest:
        """Fold in changes (see cdc.derive) of documents, and of lookup tables (see cdc.fold_lookup), in one commit;
        transactions at or below the stored position are skipped."""
        m = self.manifest()
        if m is None or not m.complete:
            raise RuleError("the store has no snapshot")
        if not self.fits(m):
            raise RuleError("the store is of another contract or source and has to be built anew")
        fresh = cdc.not_yet_applied(changes, m.last_lsn)
        ops = cdc.with_op_ids(cdc.derive(fresh), m.last_op_id)
        top, last = ops.agg(F.max("lsn"), F.max("op_id")).first()
        news = {n: cdc.not_yet_applied(df, m.last_lsn) for n, df in (lookups or {}).items()}
        tops = [x for x in (top, *(df.agg(F.max("lsn")).first()[0] for df in news.values())) if x is not None]
        if not tops:
            self.counters["skipped_batches"] += 1
            return m
        last = m.last_op_id if last is None else last
        generation = m.generation + 1
        folder = self._folder(generation)
        if self.raw:
            self._write(fresh, "raw", f"{self.uri}/raw/{generation:020d}")
        # only the stored images of the keys at hand are joined
        keys = ops.select("object_type", "object_id").distinct()
        near = self.table("current", m).join(F.broadcast(keys) if last - m.last_op_id <= FEW else keys, ["object_type", "object_id"], "left_semi")
        tail = self._write(cdc.enrich(ops, near).select(*TAIL.names), "tail", folder)
        mine = self._read_paths("tail", [tail])
        at = lambda route: F.when(F.col(route).isNotNull(), slot_column(F.col(route), m.slots))
        touched = {r[0] for r in mine.select(F.explode(F.array_compact(F.array(at("route"), at("previous_route"))))).distinct().collect()}  # at most m.slots numbers
        state = self._state(cdc.latest(ops, self.table("current", m, touched)), folder)
        same = {n: tuple(p for p in m.paths.get(n, ()) if int(p.rsplit("slot=", 1)[1]) not in touched) for n in ("current", "sums")}
        paths = {n: same[n] + state[n] for n in ("current", "sums")}
        paths |= {"tail": (*m.paths["tail"], tail), "superseded": tuple(m.paths.get("superseded", ()))}
        paths |= {n: tuple(p) for n, p in m.paths.items() if n.startswith(LOOKUP)}
        for n, df in news.items():
            old = self.lookup(n, m)
            if old is None:
                raise RuleError(f"the store has no snapshot of {n}")
            paths[f"{LOOKUP}{n}"] = (self._write(cdc.fold_lookup(df, [c for c in old.columns if c != "id"], old), f"{LOOKUP}{n}", folder),)
        floor = max(m.retained_floor, last - self.keep)
        if floor > m.retained_floor:
            whole = self._read_paths("tail", paths["tail"])
            paths["tail"] = (self._write(cdc.retained(whole, last, self.keep), "kept", folder),)
            # sums go on counting what leaves the log, as clients received it
            dropped = cdc.superseded_checkpoint(cdc.effects(whole.filter(F.col("op_id") <= last - self.keep), lambda route: route))
            sums = self.table("superseded", m).unionByName(dropped).groupBy("bucket").agg(F.sum("count").alias("count"), cdc.checksum_sum().alias("checksum"))
            paths["superseded"] = (self._write(sums.select(*SUPERSEDED.names), "superseded", folder),)
        done = self._commit(replace(m, generation=generation, last_lsn=int(max(tops)), last_op_id=last, retained_floor=floor, paths=paths))
        for name, n in (("batches", 1), ("operations", last - m.last_op_id), ("rewritten_slots", len(touched))):
            self.counters[name] += n
        self.prune()
        return done

    def clear(self, object_type: str | None = None) -> Manifest:
        """Take away all documents, or those of a type, with a new floor."""
        m = self.manifest()
        left = self.table("current", m).filter(F.lit(False) if object_type is None else F.col("object_type") != object_type)
        paths = self._state(left, self._folder(m.generation + 1))
        paths |= {n: tuple(p) for n, p in m.paths.items() if n.startswith(LOOKUP)}
        return self._commit(replace(m, generation=m.generation + 1, last_op_id=m.last_op_id + 1, snapshot_floor=m.last_op_id + 1, retained_floor=m.last_op_id + 1, paths=paths | {"tail": ()}))
