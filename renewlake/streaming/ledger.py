"""Rows by day that arrive in micro-batches: each batch counts once, whatever runs again.

A ledger is a folder with three tables. `rows` holds what each batch brought, in a folder
by day and batch; a batch that runs again replaces its own folders. `journal` notes for each
batch how many rows it brought for which day, and up to which time. `merged` holds days whose
batches have been merged into one version, so that a day that a thousand batches touched is
not read from a thousand folders; `bases` names the versions that were written to their end.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from renewlake.sources.scratch import path_exists

DAY, BATCH, PERIOD = "event_date", "batch_id", "period"
JOURNAL = T.StructType([
    T.StructField(DAY, T.DateType()), T.StructField("rows", T.LongType()), T.StructField("last_ts", T.TimestampType()),
    T.StructField(BATCH, T.LongType()),
])
BASES = T.StructType([
    T.StructField(DAY, T.DateType()), T.StructField("upto", T.LongType()), T.StructField("version", T.LongType()),
])


def on_days(days: Sequence[dt.date | None]) -> Column:
    """Rows of the given days; None is the rows without a day."""
    return _among(DAY, days)


def _among(name: str, days: Sequence[dt.date | None]) -> Column:
    known = sorted({d for d in days if d is not None})
    wanted = F.col(name).isin(known) if known else F.lit(False)
    return (wanted | F.col(name).isNull()) if None in days else wanted


class DayLedger:
    """Rows of a fixed schema (with `event_date`) in micro-batches.

    `merge` makes fewer rows of one day's rows without changing what they say: sums of
    partial sums, or one row for each event id. Reading applies it, so a ledger reads the
    same before and after its days are merged. Batches are numbered by the stream and come
    in order; only the last one may run again. With `monthly` the folders are months: for
    few rows a day.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame],
                 merge_after: int = 16, monthly: bool = False):
        if merge_after < 2:
            raise ValueError("merging needs at least two batches")
        self.spark, self.root, self.schema, self.merge, self.merge_after = spark, root, schema, merge, merge_after
        self.period = F.trunc(DAY, "month") if monthly else F.col(DAY)
        self.period_of = (lambda d: d and d.replace(day=1)) if monthly else (lambda d: d)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def journal(self) -> DataFrame:
        return self._table("journal", JOURNAL)

    def add(self, rows: DataFrame, batch_id: int, ts: str | None = None) -> list[dt.date | None]:
        """Write a batch and return its days: calendar days, so the list stays short.

        Days that `merge_after` batches have touched since their last version are merged,
        all batches before this one: that one may still run again.
        """
        names = self.schema.names
        written = rows.select(*names, self.period.alias(PERIOD), F.lit(batch_id).cast("long").alias(BATCH))
        _by_folder(written, [PERIOD, BATCH], f"{self.root}/rows")
        last = F.max(ts) if ts else F.lit(None)
        noted = rows.groupBy(DAY).agg(F.count(F.lit(1)).alias("rows"), last.cast("timestamp").alias("last_ts"))
        noted.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/journal/{BATCH}={batch_id}")
        days = [r[DAY] for r in self.journal().where(F.col(BATCH) == batch_id).select(DAY).collect()]
        self.merge_days(batch_id - 1)
        return days

    def last_ts_before(self, batch_id: int) -> dt.datetime | None:
        return self.journal().where(F.col(BATCH) < batch_id).agg(F.max("last_ts")).first()[0]

    def bases(self) -> DataFrame:
        """The newest finished version of every merged day: one row a day."""
        newest = F.max_by(F.struct("upto", "version"), "version").alias("v")
        return self._table("bases", BASES).groupBy(DAY).agg(newest).select(
            F.col(DAY).alias("_of_day"), F.col("v.upto").alias("_upto"), F.col("v.version").alias("_version"))

    def _parts(self, days: Sequence[dt.date | None] | None, upto: int | None) -> DataFrame:
        """Rows of days as they lie in folders: the newest version, and the batches after it."""
        wanted = F.lit(True)
        if days is not None:  # the literals of the periods prune folders
            wanted = _among(PERIOD, [self.period_of(d) for d in days]) & on_days(days)
        fields = [*self.schema.fields, T.StructField(PERIOD, T.DateType())]
        rows = self._table("rows", T.StructType([*fields, T.StructField(BATCH, T.LongType())])).where(wanted)
        merged = self._table("merged", T.StructType([*fields, T.StructField("version", T.LongType())])).where(wanted)
        if upto is not None:
            rows = rows.where(F.col(BATCH) <= upto)
        bases = F.broadcast(self.bases())  # a row for each calendar day
        same_day = F.col(DAY).eqNullSafe(F.col("_of_day"))
        after = rows.join(bases.select("_of_day", "_upto"), same_day, "left").where("_upto IS NULL OR batch_id > _upto")
        newest = merged.join(bases.select("_of_day", "_version"), same_day & (F.col("version") == F.col("_version")))
        names = self.schema.names
        return after.select(*names).unionByName(newest.select(*names))

    def read(self, days: Sequence[dt.date | None] | None = None) -> DataFrame:
        """Merged rows of all days, or of some."""
        return self.merge(self._parts(days, None))

    def merge_days(self, upto: int, least: int | None = None) -> list[dt.date | None]:
        """Merge days that `least` batches up to `upto` have touched since their last version.

        The version's rows are written first and named in `bases` after that, so readers see
        the old state or the new one; a merge that broke off is written again under the next
        number.
        """
        least = self.merge_after if least is None else least
        bases = self.bases()
        touched = self.journal().where(F.col(BATCH) <= upto).join(
            F.broadcast(bases), F.col(DAY).eqNullSafe(F.col("_of_day")), "left").where("_upto IS NULL OR batch_id > _upto")
        due = [r[DAY] for r in touched.groupBy(DAY).agg(F.count_distinct(BATCH).alias("n")).where(F.col("n") >= least).collect()]
        if not due:
            return []
        version = (self._table("bases", BASES).agg(F.max("version")).first()[0] or 0) + 1
        whole = self.merge(self._parts(due, upto))
        whole = whole.select(*self.schema.names, self.period.alias(PERIOD), F.lit(version).cast("long").alias("version"))
        _by_folder(whole, [PERIOD, "version"], f"{self.root}/merged")
        done = self.spark.createDataFrame([(d, upto, version) for d in due], BASES)
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/bases")
        return due


def _by_folder(df: DataFrame, by: list[str], path: str) -> None:
    """Write into folders by columns and replace just the folders that get rows.

    Rebalancing gives a folder few files, and splits one that is too large for a task.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)
    )
