"""Several tables changed together, readers never seeing half a change.

Data files are written first under a new run folder. A one-file manifest that lists, for every
table and part, the folder now in force is written last. Readers take the newest manifest, so a
run that dies half-way leaves the previous state in force. Only the parts a run touches are
rewritten; the others are carried over by reference, which keeps a small batch cheap on a table
of any size. One writer at a time is assumed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor import schemas

MANIFEST = "version LONG, run_id STRING, table_name STRING, part STRING, location STRING"
WHOLE = "all"


@dataclass
class Change:
    """New content for some parts of a table.

    ``rows`` holds the complete new content of every part in ``parts``; a listed part without
    rows is thereby emptied. ``parts=None`` replaces the whole table. ``measures`` are aggregates over the rows, counted while
    they are written and published as ``statistics`` of the run; columns that only these need are ``hidden`` from the table.
    ``finish`` makes the columns of the table out of rows that travel in a shorter form; it keeps the other columns and the order of the rows.
    """

    table: str
    rows: DataFrame | None
    part: Column = field(default_factory=lambda: F.lit(WHOLE))
    parts: Iterable[str] | None = None
    append: bool = False
    measures: dict[str, Column] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    finish: Callable[[DataFrame], DataFrame] | None = None


def group_part(group: Column) -> Column:
    """Folder name of a group; a digest, so any group name makes a safe path."""
    return F.substring(F.sha2(group, 256), 1, 32)


def range_part(key: Column, width: int) -> Column:
    """Folder name of a key range. Ids grow with time, so a batch touches few ranges."""
    return F.floor(key / width).cast("string")


class VersionedTables:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    # The manifest has one row per table part: hundreds of groups or key ranges, whatever the
    # number of rows in them.
    def _entries(self) -> list:
        try:
            files = self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest").inputFiles()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return []
            raise
        versions = [int(m.group(1)) for m in (re.search(r"/version=(\d+)/", f) for f in files) if m]
        if not versions:
            return []
        return self.spark.read.schema(MANIFEST).json(self._manifest(max(versions))).collect()

    def _manifest(self, version: int) -> str:
        return f"{self.base}/manifest/version={version}"

    def version(self) -> int:
        return max((e.version for e in self._entries()), default=0)

    def last_run(self) -> str | None:
        return next((e.run_id for e in self._entries()), None)

    def has_run(self, run_id: str) -> bool:
        """Whether files that this run appended are in force."""
        own = re.compile(rf"/{re.escape(run_id)}-[0-9a-f]{{8}}/")
        return any(own.search(e.location or "") for e in self._entries())

    def tables(self) -> list[str]:
        """Names of the tables that hold rows."""
        return sorted({e.table_name for e in self._entries() if e.location})

    def parts(self, table: str) -> list[str]:
        """Names of the parts of a table that hold rows."""
        return sorted({e.part for e in self._entries() if e.table_name == table and e.location})

    def read(
        self, table: str, schema: T.StructType, parts: Iterable[str] | None = None
    ) -> DataFrame:
        """The published rows of a table, or of some of its parts; empty if there are none."""
        wanted = None if parts is None else set(parts)
        places = [
            e.location
            for e in self._entries()
            if e.table_name == table and (wanted is None or e.part in wanted) and e.location
        ]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def publish(self, run_id: str, changes: Iterable[Change]) -> int:
        """Write every change, then make all of them visible at once."""
        entries = self._entries()
        attempt = f"{run_id}-{uuid.uuid4().hex[:8]}"  # a retried run starts in folders of its own
        version = max((e.version for e in entries), default=0) + 1
        state = {(e.table_name, e.part, e.location) for e in entries if e.location}
        statistics = []
        for change, (written, counts) in self._write_all(list(changes), attempt):
            statistics += [(run_id, change.table, measure, n) for measure, n in counts.items()]
            if not change.append:
                gone = None if change.parts is None else set(change.parts)
                state = {
                    s for s in state if s[0] != change.table or (gone is not None and s[1] not in gone)
                }
            state |= {(change.table, part, place) for part, place in written}
        if statistics:
            rows = self.spark.createDataFrame(statistics, schemas.STATISTICS)
            written, _ = self._write(Change("statistics", rows, append=True), f"{self.base}/data/statistics/{attempt}")
            state |= {("statistics", part, place) for part, place in written}
        self._commit(version, run_id, state)
        return version

    def _write_all(self, changes: list[Change], attempt: str):
        """The tables are independent jobs, so the small ones run beside the large one."""
        write = inheritable_thread_target(self.spark)(
            lambda change: self._write(change, f"{self.base}/data/{change.table}/{attempt}")
        )
        with ThreadPoolExecutor(max_workers=4) as pool:
            return list(zip(changes, pool.map(write, changes)))

    def _write(self, change: Change, place: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
        if change.rows is None:
            return [], {}
        # rebalance gathers a part into few files and splits a part that is too large for one task
        rows, seen = change.rows.withColumn("_part", change.part).hint("rebalance", "_part"), None
        if change.measures:
            # observed by the tasks that write, each of which counts once, however often earlier stages run again
            seen = Observation()
            rows = rows.observe(seen, *[F.coalesce(m, F.lit(0)).cast("bigint").alias(n) for n, m in change.measures.items()])
        if change.finish:
            # the writer needs a task's rows by part: sorted while they are short, with a part that can't be null or empty, they aren't sorted again
            part = F.coalesce(F.nullif("_part", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
            rows = change.finish(rows.withColumn("_part", part).sortWithinPartitions("_part"))
        rows.drop(*change.hidden).write.partitionBy("_part").mode("error").parquet(place)
        schema = T.StructType([T.StructField("_part", T.StringType())])
        # a write without rows leaves an empty folder, which reads as no parts; any failure to read is one
        made = [r[0] for r in self.spark.read.schema(schema).parquet(place).select("_part").distinct().collect()]
        if None in made or "__HIVE_DEFAULT_PARTITION__" in made:
            raise ValueError(f"{change.table}: rows without a part")
        return [(part, f"{place}/_part={part}") for part in made], dict(seen.get) if seen else {}

    def _commit(self, version: int, run_id: str, state: set[tuple[str, str, str]]) -> None:
        rows = [(version, run_id, *s) for s in sorted(state)] or [(version, run_id, "", "", "")]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("error").json(self._manifest(version))
