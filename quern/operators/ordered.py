"""Order within sessions by range partitions: a session of any size spreads over many tasks.

Rows are dealt by ranges of (session, time, id). Each range numbers its own rows and takes its own
previous rows and running sums; what a range carries on to the next one of the same session is one row
per (session, range), and only those rows are put in order within a session. The results are those of
a window over the whole session. Rows of equal time and id stay in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import written

PART = ["session_id", "part"]


def _inside():
    return Window.partitionBy(*PART).orderBy("captured_at", "id")


def _earlier():
    """The ranges of a session before one."""
    return Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def ranged(samples: DataFrame, partitions: int | None = None) -> DataFrame:
    """Samples of a session with the number of their range (``part``), written once, as ranges come from a sample of the keys.

    Rows without a session are left out.
    """
    n = partitions or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = samples.where("session_id is not null").repartitionByRange(n, "session_id", "captured_at", "id")
    return written(dealt.withColumn("part", F.spark_partition_id()), "ranges")


def with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Ranged rows with ``place`` (from 0) in their session and ``before``: these columns of the row before, null for the first."""
    own = F.struct(*columns)
    local = rows.withColumns({"nth": F.row_number().over(_inside()), "lag": F.lag(own).over(_inside())})
    ends = local.groupBy(*PART).agg(F.max("nth").alias("n"), F.max_by(own, "nth").alias("last"))
    carried = ends.select(
        *PART,
        F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("start"),
        F.lag("last").over(Window.partitionBy("session_id").orderBy("part")).alias("carried"),
    )
    place, before = (F.col("start") + F.col("nth") - 1).cast("int"), F.coalesce("lag", "carried")
    joined = local.join(carried, PART)
    return joined.select(*rows.columns, place.alias("place"), before.alias("before"))


def running_sum(rows: DataFrame, number: str, name: str) -> DataFrame:
    """Ranged rows with the sum, called ``name``, of a column of numbers from the session's first row to this one."""
    upto = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*PART).agg(F.sum(number).alias("total"))
    carried = sums.select(*PART, F.coalesce(F.sum("total").over(_earlier()), F.lit(0)).alias("start"))
    local = rows.withColumn("upto", F.sum(number).over(upto))
    return local.join(carried, PART).select(*rows.columns, (F.col("start") + F.col("upto")).alias(name))
