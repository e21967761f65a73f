"""Pages from files, and files from results: readers and sinks over Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rscframe.kernel.flight import dumps
from rscframe.operators import tables


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (a hash of the path), url (the path) and html: each file a page; invalid UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode(F.col("content"), "UTF-8").alias("html"))


def page_objects(df: DataFrame, **where: str) -> DataFrame:
    """A row a page: its resolved chunks as one JSON object, in order; a chunk too long to be written out is null."""

    def make(p):
        yield ("{" + ", ".join(f"{dumps(k)}: {p.text(k) or 'null'}" for k in p.rows) + "}",)

    return tables.page_rows(df, make, "value string", **where)


def record_keys(found: DataFrame) -> list[str]:
    """All keys of the matches, sorted; what comes to the driver is as large as a table's header."""
    return [r[0] for r in found.select(F.explode("keys").alias("k")).distinct().orderBy("k").collect()]


def flat_records(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches as a table of strings, a column for each key (all keys, sorted, unless they are given); nested values as JSON."""
    names = record_keys(found) if keys is None else keys
    values = F.from_json("value_json", "map<string,string>")
    return found.select(values.alias("_m")).select(*[F.try_element_at("_m", F.lit(k)).alias(k) for k in names])


def write_csv(found: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Matches as CSV files with a header; no matches give no columns, hence an empty table of one."""
    rows = flat_records(found, keys)
    if not rows.columns:
        rows = rows.select(F.lit(None).cast("string").alias("empty")).limit(0)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, **where: str) -> None:
    """Resolved pages, a JSON object a line."""
    page_objects(df, **where).select("value").write.mode("overwrite").text(path)
