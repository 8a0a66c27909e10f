"""Markdown reports: a small frame as lines of a table, the lines made in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cell(c: str, kind: str) -> Column:
    shown = F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c).cast("double"))) if kind in ("double", "float") else F.concat_ws(", ", c) if kind.startswith("array<string") else F.col(c).cast("string")
    return F.coalesce(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("n/a"))


def lines(rows: DataFrame, order: list[Column], titles: dict[str, str] | None = None) -> DataFrame:
    """(line, text): head, rule and a line for each row in the given order; numbers have three places, nulls are n/a and bars are escaped.
    rows are a report, so one task orders them."""
    names = [(titles or {}).get(c, c) for c in rows.columns]
    rule = ["---:" if t in ("double", "float", "int", "bigint", "long") else "---" for _, t in rows.dtypes]
    body = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(c, t) for c, t in rows.dtypes)), F.lit(" |"))
    made = body.select((F.col("_n") + 1).alias("line"), cells.alias("text"))
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(names)} |"), (1, f"|{'|'.join(rule)}|")], "line int, text string")
    return head.unionByName(made)


def write(parts: list[tuple[str, DataFrame]], path: str) -> None:
    """A report of parts (heading, lines) as one text file."""
    out = None
    for k, (heading, table) in enumerate(parts):
        spark = table.sparkSession
        top = spark.createDataFrame([(k, -2, f"## {heading}"), (k, -1, "")], "part int, line int, text string")
        end = spark.createDataFrame([(k, 2**30, "")], "part int, line int, text string")
        part = top.unionByName(table.select(F.lit(k).alias("part"), "line", "text")).unionByName(end)
        out = part if out is None else out.unionByName(part)
    out.orderBy("part", "line").select("text").coalesce(1).write.mode("overwrite").text(path)
