"""Tables and reports that queries leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_variant(df: DataFrame, path: str, variant: str, partition: tuple[str, ...] = ("day_ts",)) -> None:
    """Rows of one variant of a table, so that two ways of working can be compared; other variants stay as they are."""
    df.withColumn("variant", F.lit(variant)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant", *partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, in one file: for tables of results, not for data."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown(df: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """A report as lines of Markdown (line_no, line): a title, the table's head, and a line for each row in order.

    The rows are numbered in one task: for tables of results, not for data.
    """
    from pyspark.sql import Window

    bar = lambda cells: "| " + " | ".join(cells) + " |"
    head = [f"## {title}", "", bar(df.columns), bar(["---"] * len(df.columns))]
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "line_no long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]), F.lit(" |"))
    number = F.row_number().over(Window.orderBy(*order)) + (len(head) - 1)
    return top.unionByName(df.select(number.cast("long").alias("line_no"), line.alias("line")))
