"""Totals kept up to date while files change and go, without counting everything again.

The rows of a unit (a file) are replaced together. What a batch changes is signed: old
rows of its units count -1, new ones +1, so counts and sums of the groups it touches
follow from their last values and the signed rows. A least or greatest value is kept
the same way while no row that held it goes; groups that lost one are worked out
again from their present rows, and only these.

Below ``folder``, ``rows`` and ``units`` hold what each batch brought, ``totals`` the
groups each batch changed (``n`` = 0 where none is left). A batch reads those before it
and overwrites its own folders, so one that is retried gives the same. Old batches can
be compacted by starting a new folder with the present rows as its first batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DROPPED = "dropped"  # a row where this is true is not counted: it announces a unit that may have no rows left


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


class MaintainedTotals:
    """Totals per ``keys`` of the rows of all present units.

    ``sums`` names integer columns to be summed, ``extremes`` columns whose least and
    greatest values are kept as ``least_*`` and ``greatest_*``. Null keys are groups.
    """

    def __init__(
        self, spark: SparkSession, folder: str, unit: str, keys: list[str], sums: dict[str, Column], extremes: list[str]
    ):
        self.spark, self.folder, self.unit, self.keys = spark, folder.rstrip("/"), unit, keys
        self.sums, self.extremes = sums, extremes
        self.columns = ["n", *sums, *[f"{end}_{c}" for c in extremes for end in ("least", "greatest")]]

    def read(self, before: int | None = None) -> DataFrame:
        """Totals now, or as they were before a batch."""
        return self._latest(before).filter("n > 0")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Take in the new rows of some units; each unit's rows all come in one batch."""
        if DROPPED not in rows.columns:
            rows = rows.withColumn(DROPPED, F.lit(False))
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        new = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/batch={batch}")
        new.select(self.unit).distinct().write.mode("overwrite").parquet(f"{self.folder}/units/batch={batch}")
        touched = self.spark.read.parquet(f"{self.folder}/units/batch={batch}")
        earlier = self._live(batch)
        old = earlier.join(touched, _same(earlier, touched, [self.unit]), "left_semi")
        change = self._change(old, new.filter(f"not coalesce({DROPPED}, false)"))
        self._merged(change, batch).write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")

    def stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in all present input of a stream, batch by batch."""
        return (
            rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def _stored(self, kind: str, before: int | None) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.folder}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found if before is None else found.filter(F.col("batch") < before)

    def _live(self, before: int) -> DataFrame:
        """Rows of the units as they were before a batch."""
        rows = self._stored("rows", before).filter(f"not coalesce({DROPPED}, false)")
        last = self._stored("units", before).groupBy(self.unit).agg(F.max("batch").alias("batch"))
        return rows.join(last, _same(rows, last, [self.unit, "batch"]), "left_semi").drop("batch", DROPPED)

    def _latest(self, before: int | None) -> DataFrame:
        stored = self._stored("totals", before)
        values = F.struct(*self.columns)
        last = stored.groupBy(*self.keys).agg(F.max_by(values, "batch").alias("_last"))
        return last.select(*self.keys, *[F.col(f"_last.{c}").alias(c) for c in self.columns])

    def _change(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Signed totals per group; the old and the new extremes apart."""
        sign = F.col("_sign")
        rows = old.withColumn("_sign", F.lit(-1).cast("long")).unionByName(
            new.drop(DROPPED).withColumn("_sign", F.lit(1).cast("long")))
        ends = []
        for c in self.extremes:
            kept, gone = F.when(sign > 0, F.col(c)), F.when(sign < 0, F.col(c))
            ends += [F.min(kept).alias(f"least_{c}"), F.max(kept).alias(f"greatest_{c}"),
                     F.min(gone).alias(f"_gone_least_{c}"), F.max(gone).alias(f"_gone_greatest_{c}")]
        sums = [F.coalesce(F.sum(sign * value), F.lit(0)).alias(name) for name, value in self.sums.items()]
        return rows.groupBy(*self.keys).agg(F.sum(sign).alias("n"), *sums, *ends)

    def _merged(self, change: DataFrame, batch: int) -> DataFrame:
        """The changed groups' totals after a batch."""
        if self._stored("totals", None) is None:
            return change.select(*self.keys, *self.columns)
        before = self._latest(batch)
        before = before.select(*self.keys, *[F.col(c).alias(f"_was_{c}") for c in self.columns])
        both = change.join(before, _same(change, before, self.keys), "left").drop(*[before[k] for k in self.keys])
        both = both.withColumns({c: F.col(c) + F.coalesce(f"_was_{c}", F.lit(0)) for c in ["n", *self.sums]})
        lost = F.lit(False)
        for c in self.extremes:
            for end, beyond in (("least", lambda a, b: a <= b), ("greatest", lambda a, b: a >= b)):
                name, was, gone = F.col(f"{end}_{c}"), F.col(f"_was_{end}_{c}"), F.col(f"_gone_{end}_{c}")
                lost = lost | F.coalesce(beyond(gone, was) & ~F.coalesce(beyond(name, was), F.lit(False)), F.lit(False))
        pick = {"least": F.least, "greatest": F.greatest}
        kept = {f"{end}_{c}": pick[end](f"{end}_{c}", f"_was_{end}_{c}") for c in self.extremes for end in pick}
        merged = both.withColumn("_lost", lost & (F.col("n") > 0)).withColumns(kept)
        if not self.extremes:
            return merged.select(*self.keys, *self.columns)
        groups = merged.filter("_lost").select(*self.keys)
        now = self._live(batch + 1)
        again = now.join(groups, _same(now, groups, self.keys), "left_semi").groupBy(*self.keys).agg(
            *[fn(c).alias(f"_now_{end}_{c}") for c in self.extremes for end, fn in (("least", F.min), ("greatest", F.max))])
        out = merged.join(again, _same(merged, again, self.keys), "left").drop(*[again[k] for k in self.keys])
        worked = {name: F.when(F.col("_lost"), F.col(f"_now_{name}")).otherwise(F.col(name)) for name in kept}
        empty = {name: F.when(F.col("n") > 0, value) for name, value in worked.items()}
        return out.withColumns(empty).select(*self.keys, *self.columns)
