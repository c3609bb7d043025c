"""Tables that go from one version to the next all at once.

A change writes its data into new folders beside the old ones; nothing refers to them yet. Its last step writes
one small manifest, the list of folders that make up every table from then on, and the version is current. A run
that is lost before that leaves the old version as it was; a reader that has begun keeps the version it began with.

A table is a list of segments. A *snapshot* has one, which the next snapshot replaces; an *append* adds one; a
*range* replaces all rows of a span of dates, so a date that the new rows no longer have is gone: older segments
are read only outside the span. Dated segments are partitioned by month and clustered by the columns that
readers filter on, so reports skip months, files and row groups.

Everything goes through Spark's own reader and writer, so the folder may be in any store that Spark reaches. One
writer at a time: a change whose starting version is no longer current is refused.
"""

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fenceline.sources.shared import folders, remove

MONTH = "part_month"
DAY = dt.timedelta(days=1)
MANIFEST = "version bigint, segments array<struct<table:string,path:string,schema:string,first:string,last:string>>"


class UnknownTable(ValueError):
    pass


class StaleVersion(ValueError):
    pass


@dataclass(frozen=True)
class Segment:
    """Rows in one folder; with ``first`` and ``last`` only those of these dates count."""

    table: str
    path: str
    schema: str
    first: dt.date | None = None
    last: dt.date | None = None

    def without(self, first: dt.date, last: dt.date) -> list["Segment"]:
        """What of this segment lies before and after a span of dates."""
        before = replace(self, last=min(self.last, first - DAY))
        after = replace(self, first=max(self.first, last + DAY))
        return [s for s in dict.fromkeys((before, after)) if s.first <= s.last]


def _month(day: dt.date) -> int:
    return day.year * 100 + day.month


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def current(self) -> int:
        """The number of the current version; 0 where nothing was committed yet."""
        return self._manifests().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def segments(self, version: int | None = None) -> list[Segment]:
        """The segments of a version: one small record, grown by one segment per change and table."""
        version = self.current() if version is None else version
        if version == 0:
            return []
        row = self._manifests().where(F.col("version") == version).first()
        if row is None:
            raise UnknownTable(f"there is no version {version}")
        dates = [{k: s[k] and dt.date.fromisoformat(s[k]) for k in ("first", "last")} for s in row["segments"]]
        return [Segment(s["table"], s["path"], s["schema"], **d) for s, d in zip(row["segments"], dates)]

    def has(self, table: str, version: int | None = None) -> bool:
        return any(s.table == table for s in self.segments(version))

    def read(
        self, table: str, version: int | None = None, first: dt.date | None = None, last: dt.date | None = None
    ) -> DataFrame:
        """A table as of a version (the current one), if wanted only the dates ``first`` to ``last``.

        Months outside the dates are not opened, and segments that have none of them are not read."""
        own = [s for s in self.segments(version) if s.table == table]
        if not own:
            raise UnknownTable(f"version {version or 'now'} has no table {table}")
        return _together([self._rows(s, first, last) for s in _wanted(own, first, last)])

    def _rows(self, segment: Segment, first: dt.date | None, last: dt.date | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(segment.schema))
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{segment.path}")
        if segment.first is None:
            inside = [] if first is None else [F.col("date") >= F.lit(first)]
            inside += [] if last is None else [F.col("date") <= F.lit(last)]
            return reduce(DataFrame.where, inside, rows)
        low, high = max(segment.first, first or segment.first), min(segment.last, last or segment.last)
        rows = rows.where(F.col(MONTH).between(_month(low), _month(high)))
        return rows.where(F.col("date").between(F.lit(low), F.lit(high))).drop(MONTH)

    def begin(self) -> "Change":
        return Change(self)

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last ``keep`` versions needs, such as those of lost runs; how many."""
        last = self.current()
        kept = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.segments(v)}
        old = [f"{self.root}/manifests/{v:012d}" for v in range(1, last - keep + 1)]
        unused = [p for p in folders(self.spark, f"{self.root}/data") if f"data/{p.rsplit('/', 1)[-1]}" not in kept]
        for path in (*old, *unused):
            remove(self.spark, path)
        return len(unused)


def _together(parts: list[DataFrame]) -> DataFrame:
    """Segments as one table; columns that older ones lack are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _wanted(segments: list[Segment], first: dt.date | None, last: dt.date | None) -> list[Segment]:
    out = [
        s for s in segments if s.first is None or ((first is None or s.last >= first) and (last is None or s.first <= last))
    ]
    return out or segments[:1]  # an empty span is still a table


class Change:
    """Tables of the next version; nothing is visible before ``commit``."""

    def __init__(self, tables: VersionedTables):
        self.tables, self.base = tables, tables.current()
        self.segments = tables.segments(self.base)

    def _path(self, table: str) -> str:
        return f"data/{table}-{self.base + 1:012d}-{uuid.uuid4().hex[:12]}"

    def _write(self, table: str, df: DataFrame) -> Segment:
        path = self._path(table)
        df.write.parquet(f"{self.tables.root}/{path}")
        return Segment(table, path, df.schema.json())

    def snapshot(self, table: str, df: DataFrame) -> None:
        """``df`` becomes the whole table."""
        new = self._write(table, df)
        self.segments = [s for s in self.segments if s.table != table] + [new]

    def append(self, table: str, df: DataFrame) -> None:
        self.segments = [*self.segments, self._write(table, df)]

    def replace_range(self, table: str, df: DataFrame, first: dt.date, last: dt.date, cluster: tuple[str, ...] = ()) -> None:
        """The rows of ``df`` with a ``date`` from ``first`` to ``last`` are all that the table has there from now on."""
        month = F.year("date") * 100 + F.month("date")
        rows = df.where(F.col("date").between(F.lit(first), F.lit(last))).withColumn(MONTH, month)
        order = [MONTH, *cluster, "date"]
        path = self._path(table)
        # By range, a month of many rows is several files, each with its own part of the first clustering column.
        sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_rows.write.partitionBy(MONTH).parquet(f"{self.tables.root}/{path}")
        others = [s for s in self.segments if s.table != table]
        own = [s for s in self.segments if s.table == table]
        if any(s.first is None for s in own):
            raise ValueError(f"{table} is not kept by date")
        left = [part for s in own for part in s.without(first, last)]
        self.segments = [*others, *left, Segment(table, path, rows.schema.json(), first, last)]

    def compact(self, table: str, cluster: tuple[str, ...] = ()) -> None:
        """Write the segments of a dated table as one, so that many small runs do not slow readers down."""
        own = [s for s in self.segments if s.table == table]
        rows = _together([self.tables._rows(s, None, None) for s in own])
        self.replace_range(table, rows, min(s.first for s in own), max(s.last for s in own), cluster)

    def commit(self) -> int:
        """Make all changes current at once and return the new version."""
        if self.tables.current() != self.base:
            raise StaleVersion(f"version {self.base} is no longer current")
        version = self.base + 1
        rows = [tuple(v.isoformat() if isinstance(v, dt.date) else v for v in asdict(s).values()) for s in self.segments]
        manifest = self.tables.spark.createDataFrame([(version, rows)], MANIFEST).coalesce(1)
        # A folder that a lost commit has left has no rows and may be overwritten.
        manifest.write.mode("overwrite").json(f"{self.tables.root}/manifests/{version:012d}")
        return version
