"""Pages encoded from base tables, natively, so that what is decoded can be held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row(key: Column, value: Column) -> Column:
    return F.concat(key.cast("string"), F.lit(":"), value)


def pages(rows: DataFrame, page: Column, order: list[str], body: str = "row", pushes: int = 2) -> DataFrame:
    """page_id, html: the rows of a page joined by line feeds and cut into push calls."""
    grouped = rows.select(page.cast("long").alias("page_id"), F.struct(*[F.col(o) for o in order], F.col(body).alias("body")).alias("s")).groupBy("page_id").agg(F.array_sort(F.collect_list("s")).alias("rs"))
    stream = F.array_join(F.col("rs.body"), "\n")
    out = grouped.select("page_id", stream.alias("stream")).withColumn("n", F.ceil(F.length("stream") / pushes).cast("int"))
    parts = F.sequence(F.lit(0), F.lit(pushes - 1))
    calls = F.transform(parts, lambda i: F.concat(F.lit("<script>self.__next_f.push([1,"), _quoted(F.substring(F.col("stream"), i * F.col("n") + 1, F.col("n"))), F.lit("])</script>")))
    return out.select("page_id", F.concat(F.lit('<!DOCTYPE html><html lang="en"><body>'), F.array_join(calls, ""), F.lit("</body></html>")).alias("html"))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("a")))
    return whole.substr(F.lit(6), F.length(whole) - 6)
