"""Messages stored by time: folders of whole days, files sorted inside, so that a range of dates reads the files of its days alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS
from .filters import AttachmentFilter, MessageFilter

#: Files that the rows of one folder are dealt to by id at least, so that a busy day is many tasks.
FILES = 2


def day_of(date: Column, days: int = 1) -> Column:
    """The first day of the folder of a date in milliseconds, counted from 1970."""
    return (F.floor(date / (DAY_MS * days)) * days).cast("int")


def write_by_day(df: DataFrame, path: str, days: int = 1, column: str = "date", key: str = "id") -> None:
    """Writes rows into folders of ``days`` days each. Folders that get rows are put in place of what they held, others stay (dynamic
    overwrite), so a day can be written again by itself. Null dates have a folder of their own, which no range reads."""
    dealt = df.withColumn("day", day_of(F.col(column), days)).repartition("day", F.pmod(F.xxhash64(key), F.lit(FILES)))
    dealt.sortWithinPartitions("day", column, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def within_days(low: int | None, high: int | None, days: int = 1) -> Column:
    """The folders that a range of dates lies in; both bounds belong to it and None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("day") >= low // (DAY_MS * days) * days)
    if high is not None:
        out = out & (F.col("day") <= high // (DAY_MS * days) * days)
    return out


def read_by_day(spark: SparkSession, path: str, what: MessageFilter | AttachmentFilter, accounts=None, days: int = 1) -> DataFrame:
    """The hits of a filter in a table of ``write_by_day`` (by ``date``): its range of dates prunes folders, and this and all other
    bounds are tested against what files tell of their rows before these are read."""
    return spark.read.parquet(path).where(within_days(what.since, what.before, days)).where(what.column(accounts)).drop("day")
