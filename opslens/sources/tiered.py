"""A table of hot and cold rows in Parquet folders, of which a manifest says which ones count."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from opslens import schemas
from opslens.functions.exprs import keyed_id, micros, row_digest
from opslens.sources import tables

TIER, DAY = "__tier", "__day"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
HOT, COLD = "hot", "cold"


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


class TieredTable:
    """Rows with a time `ts`, appended in batches, moved from hot to cold by age, and merged into larger folders.

    Every change writes new folders first, one per tier and day (or another `grain` of time: week, month), and then one manifest that lists all folders that count, with their rows, range
    of times, checksum and bytes. A manifest has the next number and is created only if there is none of that number, so of two
    writers one starts again. Readers take the newest whole manifest: a run that dies at any point leaves the table as it was, or as it becomes, for both
    tiers at once. A batch or an archive run that is repeated finds itself in the manifest and changes nothing.

    What is written is compared with what was to be written, by count and order-free checksum: the one taken in the pass that writes, the other read
    back. A null time stays hot. The manifest has a line per folder; `merge` keeps their number at the logarithm of the batches, times the days.
    """

    def __init__(
        self, spark: SparkSession, base: str, name: str, ts: str, project_id: str = "", branch_id: str = "", grain: str = "day", on_step: Callable[[str], None] = lambda step: None
    ):
        self.grain, self.spark, self.base, self.name, self.ts = grain, spark, base.rstrip("/"), name, ts
        self.project_id, self.branch_id, self.on_step = project_id, branch_id, on_step
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    # ---- manifest

    def _names(self, folder: str) -> list:
        path = self._path(f"{self.base}/{folder}")
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def manifest(self) -> dict:
        """The newest whole manifest. One that was cut off while it was written does not count, but its number stays taken."""
        numbers = sorted((int(s.getPath().getName().removesuffix(".json")) for s in self._names("manifest")), reverse=True)
        for n in numbers:
            stream = self._fs.open(self._path(f"{self.base}/manifest/{n:010d}.json"))
            try:
                found = json.loads(self._io.toString(stream, "UTF-8"))
                return {**found, "next": numbers[0] + 1}
            except json.JSONDecodeError:
                continue
            finally:
                stream.close()
        return {"next": (numbers[0] if numbers else 0) + 1, "schema": None, "folders": [], "batches": [], "runs": []}

    def _commit(self, before: dict, **changed) -> None:
        self.on_step("before commit")
        path = self._path(f"{self.base}/manifest/{before['next']:010d}.json")
        text = json.dumps({**{k: v for k, v in before.items() if k != "next"}, **changed})
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(path)) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        self.on_step("after commit")

    def _until_committed(self, change: Callable[[dict], object], attempts: int = 5) -> object:
        for _ in range(attempts - 1):
            try:
                return change(self.manifest())
            except Conflict:
                continue
        return change(self.manifest())

    # ---- folders

    def _write(self, rows: DataFrame, tier) -> list[dict]:
        """Write rows to new folders, per tier and day, and describe them."""
        folder, seen = f"data/{uuid.uuid4().hex}", Observation(f"tiered-{uuid.uuid4().hex}")
        digest = row_digest([f"`{c}`" for c in rows.columns])
        placed = rows.withColumns({TIER: tier, DAY: F.to_date(F.date_trunc(self.grain, F.col(self.ts)))}).hint("rebalance", TIER, DAY)
        placed.observe(seen, F.count("*").alias("rows"), F.sum(digest).alias("sum")).write.partitionBy(TIER, DAY).parquet(f"{self.base}/{folder}")
        self.on_step("folders written")
        full = StructType([*rows.schema.fields, StructField(TIER, StringType()), StructField(DAY, DateType())])
        at = micros(F.col(self.ts))
        described = self.spark.read.schema(full).parquet(f"{self.base}/{folder}").groupBy(TIER, DAY).agg(
            F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum(digest).alias("sum")
        ).collect()  # a row per tier and day
        got = (sum(r["rows"] for r in described), sum(int(r["sum"]) for r in described))
        wanted = seen.get
        if got != (wanted["rows"], int(wanted["sum"] or 0)):
            raise RuntimeError(f"{folder} differs from its source: {got} against {wanted}")
        self.on_step("folders compared")
        out = []
        for r in described:
            day = r[DAY].isoformat() if r[DAY] else None
            path = f"{folder}/{TIER}={r[TIER]}/{DAY}={day or NO_DAY}"
            size = self._fs.getContentSummary(self._path(f"{self.base}/{path}")).getLength()
            out.append({"path": path, "tier": r[TIER], "day": day, "rows": r["rows"], "first": r["first"], "last": r["last"], "sum": str(r["sum"]), "bytes": size})
        return out

    def _merged_schema(self, old: str | None, new: StructType) -> StructType:
        """Columns of both, the known ones first; a known column keeps its type."""
        if old is None:
            return new
        known = StructType.fromJson(json.loads(old))
        for f in new.fields:
            if f.name in known.names and known[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {known[f.name].dataType.simpleString()} and not {f.dataType.simpleString()}")
        return StructType([*known.fields, *[f for f in new.fields if f.name not in known.names]])

    def _read(self, manifest: dict, folders: Sequence[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType([])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{f['path']}" for f in folders])

    # ---- changes

    def append(self, rows: DataFrame, batch: str) -> int:
        """Add rows as hot ones; the rows added, 0 for a batch that is there already. Columns may be new; missing ones are null."""

        def change(m: dict) -> int:
            if batch in m["batches"]:
                return 0
            schema = self._merged_schema(m["schema"], rows.schema)
            new = self._write(rows, F.lit(HOT))
            self._commit(m, schema=schema.json(), folders=[*m["folders"], *new], batches=[*m["batches"], batch])
            return sum(f["rows"] for f in new)

        return self._until_committed(change)

    def archive(self, as_of: datetime, days: int = 90) -> dict:
        """Move rows older than `days` to the cold tier; the record of the run, also for one that was done before.

        A folder whose rows are all old changes its tier in the manifest and is not read. Only folders on both sides of the limit, which is the day of
        the limit, are read, once, and split.
        """
        limit = as_of - timedelta(days=days)
        key = [F.lit(x) for x in (self.base, self.name, as_of.isoformat(), str(days))]
        edge, run_id = self.spark.range(1).select(micros(F.lit(limit.isoformat(sep=" ")).cast("timestamp")), keyed_id(*key)).first()

        def change(m: dict) -> dict:
            done = [r for r in m["runs"] if r["archival_id"] == run_id]
            if done:
                return done[0]
            hot = [f for f in m["folders"] if f["tier"] == HOT and f["first"] is not None and f["first"] < edge]
            whole, both = [f for f in hot if f["last"] < edge], [f for f in hot if f["last"] >= edge]
            rest = [f for f in m["folders"] if f not in hot]
            split = self._write(self._read(m, both), F.when(micros(F.col(self.ts)) < edge, COLD).otherwise(HOT)) if both else []
            moved = [{**f, "tier": COLD} for f in whole] + [f for f in split if f["tier"] == COLD]
            record = {
                "archival_id": run_id, "project_id": self.project_id, "branch_id": self.branch_id, "source_table": self.name, "archive_table": f"{self.name}_cold",
                "rows_archived": sum(f["rows"] for f in moved), "bytes_reclaimed": sum(f["bytes"] for f in moved), "cold_threshold_days": days,
                "archived_at": as_of.isoformat(sep=" "), "status": "success" if moved else "no_cold_data",
            }
            self._commit(m, folders=[*rest, *moved, *[f for f in split if f["tier"] == HOT]], runs=[*m["runs"], record])
            return record

        return self._until_committed(change)

    def merge(self, fan: int = 4) -> int:
        """Join folders of one tier, day and size class, once there are `fan` of them; the folders that went. Sizes of a class differ by less
        than `fan` times, so a row is rewritten a logarithm of times."""

        def change(m: dict) -> int:
            classes = defaultdict(list)
            for f in m["folders"]:
                size, level = f["bytes"], 0
                while size >= fan:
                    size, level = size // fan, level + 1
                classes[f["tier"], f["day"], level].append(f)
            old = [f for group in classes.values() if len(group) >= fan for f in group]
            if not old:
                return 0
            new = [f for t in sorted({f["tier"] for f in old}) for f in self._write(self._read(m, [f for f in old if f["tier"] == t]), F.lit(t))]
            self._commit(m, folders=[*[f for f in m["folders"] if f not in old], *new])
            return len(old)

        return self._until_committed(change)

    def sweep(self, older_than: datetime) -> list[str]:
        """Remove folders that no manifest counts any more and that are older than the longest reader or writer may take."""
        live, gone = {f["path"] for f in self.manifest()["folders"]}, []
        for status in self._fs.globStatus(self._path(f"{self.base}/data/*/{TIER}=*/{DAY}=*")) or []:
            path = "/".join(status.getPath().toString().split("/")[-4:])
            if path not in live and status.getModificationTime() < older_than.timestamp() * 1000:
                self._fs.delete(status.getPath(), True)
                gone.append(path)
        return sorted(gone)

    # ---- reading

    def read(self, tier: str | None = None) -> DataFrame:
        """Rows as of the newest manifest, with their `tier`, or those of one tier."""
        m = self.manifest()
        hot, cold = (self._read(m, [f for f in m["folders"] if f["tier"] == t]) for t in (HOT, COLD))
        if tier is not None:
            return hot if tier == HOT else cold
        return hot.withColumn("tier", F.lit(HOT)).unionByName(cold.withColumn("tier", F.lit(COLD)))

    def log(self) -> DataFrame:
        """A row of data_archival_history for each archive run."""
        schema = schemas.schema_of("data_archival_history")
        runs = [tuple(r[c] if c != "archived_at" else datetime.fromisoformat(r[c]) for c in schema.names) for r in self.manifest()["runs"]]
        return self.spark.createDataFrame(runs, schema)

    def write_log(self, ops_base: str) -> int:
        """Append the runs that the operational table does not have yet; how many. Safe to repeat after a failure."""
        there = self._path(tables.path_of(ops_base, "data_archival_history"))
        new = self.log()
        if self._fs.exists(there):
            known = tables.read_ops(self.spark, ops_base, "data_archival_history").select("archival_id")
            new = new.join(known, "archival_id", "left_anti")
        return tables.append_counted(new, ops_base, "data_archival_history", f"archival-{uuid.uuid4().hex}")
