"""Sections and people's states as JSON lines, written and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "section_id long, path string, page_title string, heading string, text string, meta string"


def lines(rows: DataFrame) -> DataFrame:
    """Each row as one line of JSON (``value``); nulls are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def rows(lines: DataFrame, schema: str = SECTION) -> DataFrame:
    """The rows again; what a line doesn't have is null, a line that is no JSON gives no row."""
    corrupt = "corrupt_line"
    got = lines.where(F.trim("value") != "").select(F.from_json("value", f"{schema}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt}).alias("r"))
    return got.select("r.*").where(F.col(corrupt).isNull()).drop(corrupt)


def save(sections: DataFrame, path: str) -> None:
    lines(sections).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schema: str = SECTION) -> DataFrame:
    return rows(spark.read.text(path), schema)


def states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One state a file with ``seen``, when the file was last written; unreadable files aren't counted. ``path`` may be a glob."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("seen"))
    got = files.select("seen", F.from_json("value", f"{schema}, corrupt_line string", {"columnNameOfCorruptRecord": "corrupt_line"}).alias("r"))
    return got.select("seen", "r.*").where(F.col("corrupt_line").isNull()).drop("corrupt_line")
