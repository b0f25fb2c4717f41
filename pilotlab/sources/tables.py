"""Parquet tables in zones, under any Hadoop filesystem URI."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Zones:
    """Where the tables of each stage live."""

    root: str
    raw: str = "raw"
    trusted: str = "trusted"
    modelling: str = "for_modelling"
    reports: str = "reports"
    models: str = "models"

    def table(self, zone: str, table: str) -> str:
        return f"{self.root}/{getattr(self, zone)}/{table}/{table}.parquet"

    def folder(self, zone: str) -> str:
        return f"{self.root}/{getattr(self, zone)}"


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps here have no zone; UTC keeps casts from and to text free of daylight saving."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read_table(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """The table at ``path``; a missing optional table is ``None``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not required and error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_tables(
    spark: SparkSession, zones: Zones, zone: str, names: list[str], required: bool = True
) -> dict[str, DataFrame]:
    found = {n: read_table(spark, zones.table(zone, n), required) for n in names}
    return {n: df for n, df in found.items() if df is not None}


def write_table(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``."""
    df.write.mode("overwrite").parquet(path)


MONTH = "month"


def by_month(df: DataFrame, time: str) -> DataFrameWriter:
    """A writer of ``df`` in a folder for each month of ``time``, with rows in order of time inside the files.

    Rows without a time lie in a folder of their own. A month of many rows is split over tasks and small
    months share one, by the size of what was shuffled.
    """
    laid = df.withColumn(MONTH, F.date_format(time, "yyyy-MM")).hint("rebalance", MONTH)
    return laid.sortWithinPartitions(MONTH, time).write.partitionBy(MONTH)


def replace_months(df: DataFrame, path: str, time: str) -> None:
    """Replaces the months that ``df`` has rows of in a table of ``by_month``; all others stay."""
    by_month(df, time).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def within(df: DataFrame, time: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with ``start <= time < end``. On a table of ``by_month`` only the months between are read, also
    where a bound is a scalar subquery. Rows without a time are in no range."""
    for bound, inside, month in (
        (start, lambda t, b: t >= b, lambda m, b: m >= b), (end, lambda t, b: t < b, lambda m, b: m <= b),
    ):
        if bound is not None:
            df = df.where(inside(F.col(time), bound))
            if MONTH in df.columns:
                df = df.where(month(F.col(MONTH), F.date_format(bound, "yyyy-MM")))
    return df


class Publication:
    """Tables of a job, written to a folder of their own and put in place together.

    ``write`` takes the path that a table is to have; ``path`` gives where it lies until then. Tables replace
    those of the same path.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.folder = f"{root}/_runs/{uuid.uuid4().hex}"
        self.written: list[str] = []

    def path(self, final: str) -> str:
        if not final.startswith(f"{self.root}/"):
            raise ValueError(f"{final} is not under {self.root}")
        return f"{self.folder}/new/{final[len(self.root) + 1 :]}"

    def write(self, df: DataFrame, final: str, time: str | None = None) -> None:
        """Writes a table, in months of ``time`` if it is given."""
        writer = df.write if time is None else by_month(df, time)
        writer.mode("overwrite").parquet(self.path(final))
        self.note(final)

    def note(self, final: str) -> None:
        """Says that something was written at ``path(final)`` by other means."""
        if final not in self.written:
            self.written.append(final)

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _move(self, source: str, final: str) -> None:
        fs, target = self._fs(final)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._fs(source)[1], target):
            raise OSError(f"{source} could not be moved to {final}")

    def _put_in_place(self) -> None:
        moved: list[tuple[str, str | None]] = []
        try:
            for final in self.written:
                fs, target = self._fs(final)
                old = f"{self.folder}/old/{final[len(self.root) + 1 :]}" if fs.exists(target) else None
                if old is not None:
                    self._move(final, old)
                moved.append((final, old))
                self._move(self.path(final), final)
        except BaseException:
            for final, old in reversed(moved):
                fs, target = self._fs(final)
                if old is not None:
                    fs.delete(target, True)
                    self._move(old, final)
                elif fs.exists(target):
                    fs.delete(target, True)
            raise
        finally:
            self._clear()

    def _clear(self) -> None:
        fs, target = self._fs(self.folder)
        fs.delete(target, True)
        runs = target.getParent()
        if fs.exists(runs) and not fs.listStatus(runs):
            fs.delete(runs, False)


@contextmanager
def publication(spark: SparkSession, root: str) -> Iterator[Publication]:
    """All tables written inside replace the old ones at the end, or none does: an error on the way leaves
    the old tables as they were. Stage tables given out inside are removed either way.

    Moving is a rename for each table. On a file system a reader can see the new tables one after the
    other for that moment; a driver lost within it leaves the old ones under ``_runs``.
    """
    out = Publication(spark, root)
    with stage_scope() as made:
        try:
            yield out
        except BaseException:
            out._clear()
            raise
        else:
            out._put_in_place()
        finally:
            drop_stages(spark, made)


@dataclass(frozen=True)
class BucketedStore:
    """A table at ``path`` in buckets of a text key, sorted by it: one key reads one bucket, and a join on the
    key moves only the other side. ``key`` is the text of the column that it was made from."""

    path: str
    buckets: int
    KEY = "lookup_key"

    def save(self, df: DataFrame, column: str) -> None:
        """Stores ``df``; replaces what is at the path. Rows with a null key are kept but never found."""
        name = f"store_{uuid.uuid4().hex}"
        keyed = df.withColumn(self.KEY, F.col(column).cast("string")).repartition(self.buckets, self.KEY)
        writer = keyed.write.mode("overwrite").option("path", f"{self.path}/rows").bucketBy(self.buckets, self.KEY)
        writer.sortBy(self.KEY).saveAsTable(name)
        df.sparkSession.sql(f"DROP TABLE {name}")  # the entry; the rows stay
        layout = df.sparkSession.createDataFrame([(self.buckets, keyed.schema.json())], "buckets int, schema string")
        layout.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")

    @staticmethod
    def open(spark: SparkSession, path: str) -> BucketedStore:
        return BucketedStore(path, spark.read.parquet(f"{path}/layout").first()["buckets"])

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, as a table that knows its buckets, under an entry of this session made from the path."""
        name = f"store_{hashlib.md5(self.path.encode()).hexdigest()}"
        fields = StructType.fromJson(json.loads(spark.read.parquet(f"{self.path}/layout").first()["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({self.KEY}) SORTED BY ({self.KEY})"
            f" INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        return spark.table(name)

    def one(self, spark: SparkSession, key: str) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        return self.rows(spark).where(F.col(self.KEY) == key).drop(self.KEY)

    def many(self, keys: DataFrame, column: str) -> DataFrame:
        """Each row of ``keys`` with what is stored under its ``column``, and ``found``; ids compare as text.

        Columns of ``keys`` win over stored ones of the same name. Only ``keys`` are shuffled.
        """
        stored = self.rows(keys.sparkSession)
        kept = [c for c in stored.columns if c not in keys.columns or c == self.KEY]
        stored = stored.select(*kept, F.lit(True).alias("_found"))
        wanted = keys.withColumn(self.KEY, F.col(column).cast("string"))
        joined = wanted.hint("shuffle_merge").join(stored, self.KEY, "left")
        return joined.withColumn("found", F.coalesce("_found", F.lit(False))).drop(self.KEY, "_found")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where none is set, a local session (as in tests) gets a temporary folder. Any other session is
    refused, because its executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


# Paths given out in this process and not yet removed; the innermost open scope lists its own as well.
_given: list[str] = []
_scopes: list[list[str]] = []


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the shared folder. It lasts until ``drop_stages`` removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for owner in (_given, *_scopes[-1:]):
        owner.append(path)
    return path


@contextmanager
def stage_scope() -> Iterator[list[str]]:
    """Lists the stage paths that are given out inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def drop_stages(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes stage tables, all of this process by default. Frames that read them must not be used any more."""
    for path in list(_given if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _given:
            _given.remove(path)


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Computed once, kept through the loss of executors, and with a known size, so that later joins can
    tell whether it is small.
    """
    path = stage_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
