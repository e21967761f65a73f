"""Command line: ``python -m rscframe SOURCE --keys a,b``.  SOURCE is a URL, a file or a pattern of files.

Prints one JSON value for a page; for several pages, a line of url and value each.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rscframe.functions import normalize, pages as P
from rscframe.operators import health, search, tables
from rscframe.sources import files, web

HTML_MODES = {
    "router": P.router, "locale": P.locale, "meta_tags": P.meta_tags, "api_routes": P.api_routes, "base_path": P.base_path, "error_digest": P.error_digest,
    "next_data": P.next_data, "version_hint": lambda h: F.create_map(F.lit("range"), P.version_hint(h), F.lit("bundler"), P.bundler(h)),
}


def _keys(text: str) -> list[str]:
    return [k.strip() for k in text.split(",") if k.strip()]


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.col("ord").alias("at"), F.lit("").alias("name"), F.col("value_json").alias("value"))


def _named(rows: DataFrame, value: str) -> DataFrame:
    return rows.select("url", F.col("pos").alias("at"), F.col("chunk_key").alias("name"), F.col(value).alias("value"))


def _one(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select("url", F.lit(0).alias("at"), F.lit("").alias("name"), value.alias("value"))


def summary(df: DataFrame) -> DataFrame:
    """Counts of each page and its chunk keys, as JSON."""
    counts, keys = health.stats(df, id="url"), tables.keys_of(df, id="url")
    by = {"value_type_counts": [f"type_{t.lower()}" for t in health.TYPES], "flight_row_kind_counts": [f"n_{k}" for k in health.KINDS]}
    parts = [F.map_filter(F.create_map(*[x for c in cs for x in (F.lit(c.split("_", 1)[1]), F.col(c))]), lambda _, n: n > 0).alias(name) for name, cs in by.items()]
    return _one(counts.join(keys, "url"), F.to_json(F.struct("chunk_count", F.col("keys").alias("chunk_ids"), *parts)))


#: mode: (what it takes; one value, a list or an object a page; rows of url, at, name, value for pages, the argument and the key of types)
FLIGHT_MODES = {
    "keys": (str, "one", lambda df, a, _: _found(search.find_by_keys(df, _keys(a), id="url"))),
    "all_by_keys": (str, "list", lambda df, a, _: _found(search.find_all_by_keys(df, _keys(a), id="url"))),
    "any_keys": (str, "list", lambda df, a, _: _found(search.find_any_keys(df, _keys(a), id="url"))),
    "type": (str, "list", lambda df, a, key: _found(search.find_by_type(df, a, key=key, id="url"))),
    "text": (str, "list", lambda df, a, _: search.find_text(df, a, id="url").select("url", F.col("ord").alias("at"), F.lit("").alias("name"), F.to_json(F.array("text")).alias("value")).withColumn("value", F.expr("substr(value, 2, length(value) - 2)"))),
    "get": (str, "one", lambda df, a, _: _one(tables.projected(df, [a], id="url"), F.col("p0"))),
    "json_keys": (None, "one", lambda df, a, _: _one(tables.keys_of(df, "json", id="url"), F.to_json("keys"))),
    "html_keys": (None, "one", lambda df, a, _: _one(tables.keys_of(df, "html", id="url"), F.to_json("keys"))),
    "tree": (None, "object", lambda df, a, _: _named(tables.shapes(df, id="url"), "shape")),
    "stats": (None, "one", lambda df, a, _: summary(df)),
    "pagination": (None, "one", lambda df, a, _: _found(search.find_pagination(df, id="url"))),
    "all": (None, "object", lambda df, a, _: _named(tables.resolved(df, id="url"), "value_json")),
}


def gathered(urls: list[str], rows: DataFrame, form: str) -> list[tuple]:
    """(url, value) of every page; the command line prints on the driver, so what it prints comes there."""
    by: dict = {u: [] for u in urls}
    for r in rows.orderBy("url", "at").toLocalIterator():
        by[r["url"]].append((r["name"], None if r["value"] is None else json.loads(r["value"])))
    make = {"one": lambda got: got[0][1] if got else None, "list": lambda got: [v for _, v in got], "object": dict}[form]
    return [(u, make(got)) for u, got in by.items()]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("rscframe", description=__doc__)
    out.add_argument("source")
    for name in HTML_MODES:
        out.add_argument("--" + name.replace("_", "-"), action="store_true")
    for name, (takes, *_) in FLIGHT_MODES.items():
        out.add_argument("--" + name.replace("_", "-"), **({} if takes else {"action": "store_true"}))
    out.add_argument("--type-key", default="@type")
    out.add_argument("--watch", type=float, metavar="SECONDS")
    out.add_argument("--polls", type=int, help="end --watch after so many polls")
    out.add_argument("--save")
    out.add_argument("--indent", type=int, default=2)
    out.add_argument("--redact", action="store_true")
    out.add_argument("--rsc", action="store_true")
    return out


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://"))


def load(spark: SparkSession, source: str, stream: bool):
    if not is_url(source):
        return files.pages(spark, source)
    got = web.fetched(spark.createDataFrame([(source,)], "url string"), mode="stream" if stream else "page")
    return got.select(F.xxhash64("url").alias("page_id"), "url", "html", "error")


def rendered(value, args) -> str:
    text = json.dumps(value, indent=args.indent, ensure_ascii=False, default=str)
    if args.redact:
        for pattern, by in ((normalize.EMAIL, "[REDACTED_EMAIL]"), (normalize.PHONE, "[REDACTED_PHONE]")):
            text = re.sub(pattern.removeprefix("(?U)"), by, text)
    return text


def watch(spark: SparkSession, args) -> int:
    """Polls a URL and prints what changed."""
    before, polls = None, 0
    while args.polls is None or polls < args.polls:
        now = load(spark, args.source, args.rsc).persist()
        if before is None:
            print(f"# {tables.flat(now).count()} paths, watching", flush=True)
        else:
            change: dict = {"added": {}, "removed": {}, "changed": {}}
            for r in search.diff(before, now).orderBy("path").toLocalIterator():
                old, new = (None if v is None else json.loads(v) for v in (r.old_value, r.new_value))
                change[r.change][r.path] = {"added": new, "removed": old, "changed": [old, new]}[r.change]
            print(rendered(change, args) if any(change.values()) else "# no change", flush=True)
            before.unpersist()
        before, polls = now, polls + 1
        if args.polls is None or polls < args.polls:
            time.sleep(args.watch)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if (args.rsc or args.watch is not None) and not is_url(args.source):
        p.error("--rsc and --watch need a URL")
    mode = next((m for m in [*HTML_MODES, *FLIGHT_MODES] if getattr(args, m)), None)
    if mode is None and args.watch is None:
        p.error("choose what to extract")
    spark = SparkSession.builder.appName("rscframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.watch is not None:
        return watch(spark, args)
    df = load(spark, args.source, args.rsc)
    if mode in HTML_MODES:
        rows = df.select("url", HTML_MODES[mode](F.col("html")).alias("value"))
        read = json.loads if mode == "next_data" else lambda v: v
        values = [(r.url, None if r.value is None else read(r.value)) for r in rows.toLocalIterator()]
    else:
        df = df.persist()
        _, form, of = FLIGHT_MODES[mode]
        values = gathered([r.url for r in df.select("url").toLocalIterator()], of(df, getattr(args, mode), args.type_key), form)
    if mode == "next_data" and all(v is None for _, v in values):
        print("no such data in the page", file=sys.stderr)
        return 1
    text = rendered(values[0][1], args) if len(values) == 1 else "\n".join(rendered({"url": u, "value": v}, argparse.Namespace(indent=None, redact=args.redact)) for u, v in values)
    if args.save:
        with open(args.save, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
