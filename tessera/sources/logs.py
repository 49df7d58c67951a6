"""Build logs: the last turn that each group finished."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a line that says a turn is done.
LINE = r"turn done \| .*?group_id=([^,\s]+).*?source_id=([^,\s]+)"


def last_turns(spark: SparkSession, path: str) -> DataFrame:
    """group_id and source_id of the last finished turn in a log; lines in the order of the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    found = lines.select("line_no", F.regexp_extract("line", LINE, 1).alias("group_id"), F.regexp_extract("line", LINE, 2).alias("source_id")).filter("group_id <> ''")
    return found.groupBy("group_id").agg(F.max_by("source_id", "line_no").alias("source_id"))


def latest_log(folder: str, pattern: str = "*.log") -> str | None:
    """The log of a folder that was written last; ties by name."""
    files = sorted(Path(folder).glob(pattern), key=lambda p: (p.stat().st_mtime, p.name))
    return str(files[-1]) if files else None
