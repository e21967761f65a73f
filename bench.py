"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and what pages cost.

cores: decoded and resolved as JSON, and searched for an object at 5 % of the page (early match).  ``kernel``: the same kernel in one
process without Spark, in milliseconds a page: all chunks resolved, the early match, and nanoseconds of a chunk that is resolved already.
"""

import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, str(HERE))
HEADLINE = ["find_all_by_keys", "find_by_keys_first", "resolve_references", "text_rows", "nodes", "page_stats", "parse_confidence", "page_diff", "throttle", "locale", "redact"]
SIZES = {"small": (350, 2400), "medium": (3500, 400), "large": (21000, 64)}


def pages(spark, chunks: int, count: int):
    """Pages of which 70 % of the chunks are objects, 15 % elements that refer to a chunk before, 15 % text; the one at 5 % has a key of its own."""
    from pyspark.sql import functions as F

    from rscframe.plans import synth

    n = F.col("id") % chunks
    item = F.to_json(F.struct(n.alias("id"), F.concat(F.lit("Product "), n).alias("title"), (n * 3).alias("price"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.struct((n * 7).alias("views"), (n % 2 == 0).alias("active")).alias("meta"), F.when(n == chunks // 20, F.lit("here")).alias("needle")))
    text = F.concat(F.lit('"'), F.repeat(F.lit("lorem ipsum dolor "), 16), F.lit('"'))
    body = F.when((n % 20 < 14) | (n == chunks // 20), item).when(n % 20 < 17, F.concat(F.lit('["$","div",null,{"children":"$'), F.lower(F.hex(F.greatest(n - 17, F.lit(0)).cast("long"))), F.lit('"}]'))).otherwise(text)
    rows = spark.range(count * chunks).select(F.floor(F.col("id") / chunks).alias("page"), n.alias("o"), synth.row(F.lower(F.hex(n)), body).alias("row"))
    return synth.pages(rows, F.col("page"), ["o"], pushes=max(1, chunks // 200))


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def page_rates(spark, folder: str) -> tuple[dict, dict]:
    from pyspark.sql import functions as F

    from rscframe.kernel.flight import Page
    from rscframe.operators import search, tables

    out, alone = {}, {}
    for name, (chunks, count) in SIZES.items():
        pages(spark, chunks, count).repartition(spark.sparkContext.defaultParallelism * 4).write.mode("overwrite").parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        mb = df.agg(F.sum(F.octet_length("html"))).first()[0] / 1e6
        html = df.where("page_id = 0").first()["html"]
        timed(tables.resolved(df.limit(8)))
        all_, early = min(timed(tables.resolved(df)) for _ in range(2)), min(timed(search.find_by_keys(df, ["needle"])) for _ in range(2))
        out[name] = {"kb": round(mb * 1000 / count, 1), "pages_per_s": round(count / all_, 1), "mb_per_s": round(mb / all_, 1), "early_pages_per_s": round(count / early, 1), "early_mb_per_s": round(mb / early, 1)}
        n = 5 if chunks > 10_000 else 20
        began = time.perf_counter()
        for _ in range(n):
            page = Page(html)
            page.resolve_all()
        full = (time.perf_counter() - began) / n
        began = time.perf_counter()
        for _ in range(n):
            next(v for *_, v in Page(html).objects() if isinstance(v, dict) and "needle" in v)
        found = (time.perf_counter() - began) / n
        began = time.perf_counter()
        for _ in range(100_000):
            page.resolve("1")
        alone[name] = {"resolve_all_ms": round(full * 1000, 2), "early_match_ms": round(found * 1000, 2), "warm_ns": round((time.perf_counter() - began) * 10_000, 1), "mb_per_s": round(len(html) / 1e6 / full, 1)}
    return out, alone


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from rscframe.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "256").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second counts: code is compiled, workers are up
            took[name] = round(timed(registry.QUERIES[name](spark, sf_dir)), 3)
    with tempfile.TemporaryDirectory() as folder:
        rates, alone = page_rates(spark, folder)
    took["decode_pages"] = round(SIZES["medium"][1] / rates["medium"]["pages_per_s"], 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "pages_per_s": rates["medium"]["pages_per_s"], "mb_per_s": rates["medium"]["mb_per_s"], "cores": int(cpus), "pages": rates, "kernel": alone}))


if __name__ == "__main__":
    main()
