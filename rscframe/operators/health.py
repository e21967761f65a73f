"""Page statistics and parse health, a row a page from the kernel; and windows over a crawl.

The windows follow a domain's responses in order.  So that a domain with a third of all responses is no single task, responses
are first numbered within their domain by ranges of the order (counts of ranges are summed, not rows), and then dealt out in blocks of
``BLOCK`` numbers, each with the few rows before it that its windows reach back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rscframe.kernel.flight import HTML_TAG, Page, type_name

from . import tables

KINDS = ["json", "text", "module", "preload"]
TYPES = ["dict", "list", "str", "int", "float", "bool", "NoneType"]
BLOCK = 100_000


def stats(pages: DataFrame, html: str = "html", **where: str) -> DataFrame:
    """Counts by kind and by value type, and sizes, of every page (pages without chunks too)."""

    def make(p: Page):
        kinds, types = dict.fromkeys(KINDS, 0), dict.fromkeys(TYPES, 0)
        html_like = 0
        for key, (_, _, kind, raw) in p.rows.items():
            kinds[kind] += 1
            t = type_name(p.values[key])
            types[t] = types.get(t, 0) + 1
            html_like += kind == "text" and HTML_TAG.search(raw) is not None
        yield len(p.html.encode("utf-8", "replace")), len(p.rows), types["dict"] + types["list"], html_like, *kinds.values(), *(types[t] for t in TYPES)

    names = ["html_bytes", "chunk_count", "json_chunk_count", "html_chunk_count", *(f"n_{k}" for k in KINDS), *(f"type_{t.lower()}" for t in TYPES)]
    return tables.page_rows(pages, make, ", ".join(f"{n} long" for n in names), html=html, **where)


def judged(p: Page) -> tuple:
    """(chunks, judged, raw, repaired, json, size of json, score): the score is the share of chunks other than text whose value is no raw string; 1.0 without any."""
    n = n_raw = n_repaired = n_json = size = 0
    for key, (_, _, kind, _) in p.rows.items():
        v = p.values[key]
        if isinstance(v, (dict, list)):
            n_json += 1
            size += len(v)
        if kind != "text":
            n += 1
            n_raw += isinstance(v, str)
            n_repaired += p.status[key] == "repaired"
    return len(p.rows), n, n_raw, n_repaired, n_json, size, (n - n_raw) / n if n else 1.0


def confidence(pages: DataFrame, repair: bool = False, **where: str) -> DataFrame:
    """How well each page was parsed: n_chunks, n_judged, n_raw, n_repaired, n_json, json_size, score."""
    return tables.page_rows(pages, lambda p: [judged(p)], "n_chunks long, n_judged long, n_raw long, n_repaired long, n_json long, json_size long, score double", repair=repair, **where)


def fallback_skeletons(pages: DataFrame, **where: str) -> DataFrame:
    """Pages that parse well but hold next to nothing."""
    skeleton = (F.col("score") >= 0.99) & (F.col("n_json") > 0) & (F.col("json_size") <= 2)
    return confidence(pages, **where).select(where.get("id", "page_id"), skeleton.alias("is_skeleton"))


def streamed(pages: DataFrame, **where: str) -> DataFrame:
    """Static and streamed chunk keys of each page (by the push in which a chunk's id starts), and whether it is partly prerendered."""

    def make(p: Page):
        import re

        at, marked = p.push_index(), re.compile(r'"\$@[0-9]+"').search
        late = [k for k in p.rows if at.get(k, 0) > 0]
        yield [k for k in p.rows if at.get(k, 0) <= 0], late, bool(late) and any(marked(r[3]) for r in p.rows.values())

    return tables.page_rows(pages, make, "static_chunks array<string>, dynamic_chunks array<string>, is_ppr boolean", **where)


def push_indexes(pages: DataFrame, **where: str) -> DataFrame:
    """For each row id the first push in which a row of it starts: chunk_id, push_idx."""
    return tables.page_rows(pages, lambda p: iter(p.push_index().items()), "chunk_id string, push_idx int", **where)


# a crawl's log ----------------------------------------------------------------------------------


def crawl_stats(log: DataFrame, hint: str | None = None, stopped: str | None = None) -> DataFrame:
    """One row: responses with and without data, the mean of the score, and with these columns the counts by version hint and of early stops; log: n_chunks, score."""
    data = F.col("n_chunks") > 0
    sums = [F.count_if(data).alias("n1"), F.count_if(~data).alias("n0"), F.sum(F.when(data, F.col("score"))).alias("s")]
    sums += [F.count_if(data & F.col(stopped)).alias("early")] if stopped else []
    by = F.when(data, F.coalesce(F.col(hint), F.lit("unknown"))) if hint else F.lit(None).cast("string")
    parts = log.groupBy(by.alias("hint")).agg(*sums)  # a row for each hint
    out = [F.sum("n1").alias("with_data"), F.sum("n0").alias("without_data"), F.round(F.sum("s") / F.nullif(F.sum("n1"), F.lit(0)), 4).alias("avg_confidence")]
    out += [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("hint").isNotNull(), F.struct("hint", F.col("n1").alias("n")))))).alias("version_hints")] if hint else []
    out += [F.sum("early").alias("stopped_early")] if stopped else []
    return parts.agg(*out).na.fill(0, ["with_data", "without_data"])


def numbered(rows: DataFrame, order: str, domain: str) -> DataFrame:
    """rows with ``_nth``, the place in the order of the domain (from 0), without sorting a whole domain in one task.

    The order's values are cut into ranges; a range is sorted alone, and starts where the counts of the ranges before it end.
    """
    value = F.col(order).try_cast("double")
    ends = rows.groupBy(F.col(domain).alias("_domain")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_all"))
    step = (F.col("_hi") - F.col("_lo")) / F.greatest(F.ceil(F.col("_all") / BLOCK), F.lit(1))
    cut = rows.join(ends, F.col(domain).eqNullSafe(F.col("_domain")))
    cut = cut.withColumn("_range", F.coalesce(F.when(step > 0, F.floor((value - F.col("_lo")) / step)), F.lit(0))).drop("_domain", "_lo", "_hi", "_all")
    sizes = cut.groupBy(domain, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(domain).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col(domain).alias("_domain"), F.col("_range").alias("_of"), "_start")
    own = Window.partitionBy(domain, "_range").orderBy(order)
    got = cut.withColumn("_at", F.row_number().over(own) - 1).join(starts, F.col(domain).eqNullSafe(F.col("_domain")) & (F.col("_range") == F.col("_of")))
    return got.withColumn("_nth", F.col("_start") + F.col("_at")).drop("_range", "_of", "_domain", "_start", "_at")


def dealt(rows: DataFrame, reach: int) -> DataFrame:
    """rows (``numbered``) with ``_block`` and ``_guest``: each row in its own block, and as a guest in the next if windows of that reach back to it."""
    size = max(BLOCK, reach)
    own = F.floor(F.col("_nth") / size)
    late = F.col("_nth") % size >= size - reach
    places = F.when(late, F.array(F.struct(own.alias("b"), F.lit(False).alias("g")), F.struct((own + 1).alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("g"))))
    return rows.withColumn("_p", F.explode(places)).withColumn("_block", F.col("_p.b")).withColumn("_guest", F.col("_p.g")).drop("_p")


def sums_before(log: DataFrame, order: str, domain: str) -> DataFrame:
    """The responses with data, numbered, with ``_sum``: the sum of the scores of those before in the domain."""
    rows = numbered(log.where("n_chunks > 0"), order, domain).withColumn("_block", F.floor(F.col("_nth") / BLOCK))
    parts = rows.groupBy(domain, "_block").agg(F.sum("score").alias("_part"))
    before = Window.partitionBy(domain).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(domain).alias("_domain"), F.col("_block").alias("_of"), F.coalesce(F.sum("_part").over(before), F.lit(0.0)).alias("_earlier"))
    inside = Window.partitionBy(domain, "_block").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("score").over(inside), F.lit(0.0)))
    rows = rows.join(parts, F.col(domain).eqNullSafe(F.col("_domain")) & (F.col("_block") == F.col("_of")))
    return rows.withColumn("_sum", F.col("_earlier") + F.col("_inside")).drop("_block", "_domain", "_of", "_earlier", "_inside")


def running_confidence(log: DataFrame, order: str = "seq", domain: str = "domain") -> DataFrame:
    """Each response with data, with the mean of the scores so far in its domain."""
    rows = sums_before(log, order, domain)
    return rows.withColumn("avg_confidence", F.round((F.col("_sum") + F.col("score")) / (F.col("_nth") + 1), 4)).drop("_sum", "_nth")


def throttled(log: DataFrame, window: int = 20, least: float = 0.7, order: str = "seq", domain: str = "domain", config=None) -> DataFrame:
    """Each response with data: the rolling mean, whether its domain is throttled, and where that begins or ends."""
    if config is not None:
        window, least = config.throttle_window, config.throttle_min_confidence
    rows = dealt(numbered(log.where("n_chunks > 0"), order, domain), window)
    by = Window.partitionBy(domain, "_block").orderBy("_nth")
    rows = rows.withColumn("rolling", F.avg("score").over(by.rowsBetween(1 - window, 0)))
    enough = F.least(F.col("_nth") + 1, F.lit(window)) >= max(3, window // 2)
    rows = rows.withColumn("throttled", enough & (F.col("rolling") < least))
    # a block's last guest has its whole window among the guests, so that its flag is the true one before the block
    before = F.coalesce(F.lag("throttled").over(by), F.lit(False))
    rows = rows.withColumn("step", F.when(F.col("throttled") & ~before, "enter").when(~F.col("throttled") & before, "leave"))
    return rows.where("not _guest").drop("_nth", "_block", "_guest")


def with_delays(steps: DataFrame, factor: float = 2.0, config=None) -> DataFrame:
    """What each step of throttling does to a domain's delay: multiplied by ``delay_factor`` (an empty delay becomes the factor itself)."""
    factor = config.throttle_factor if config is not None else factor
    return steps.where("step is not null").withColumn("delay_factor", F.when(F.col("step") == "enter", F.lit(factor)).otherwise(F.lit(1 / factor)))


def drifted(log: DataFrame, min_samples: int = 5, threshold: float = 0.3, order: str = "seq", domain: str = "domain", config=None) -> DataFrame:
    """Responses whose score falls by ``threshold`` or more below the mean of those before."""
    if config is not None:
        min_samples, threshold = config.drift_min_samples, config.drift_threshold
    rows = sums_before(log, order, domain).withColumn("mean_before", F.col("_sum") / F.nullif(F.col("_nth"), F.lit(0)))
    return rows.where((F.col("_nth") >= min_samples) & (F.col("mean_before") - F.col("score") >= threshold)).drop("_sum", "_nth")


def retries(log: DataFrame, least: float = 0.5, most: int = 2, vendor: str | None = "vendor", config=None) -> DataFrame:
    """Responses to fetch again, with the reason and the number of the attempt; log: n_chunks, score, attempt."""
    if config is not None:
        least, most = config.retry_min_confidence, config.retry_max_times
    reason = F.concat(F.lit("low confidence "), F.round("score", 2).cast("string"), F.coalesce(F.concat(F.lit(" ("), F.col(vendor), F.lit(")")), F.lit("")) if vendor else F.lit(""))
    return log.where((F.col("n_chunks") > 0) & (F.col("score") < least) & (F.col("attempt") < most)).withColumn("reason", reason).withColumn("attempt", F.col("attempt") + 1)


def first_hints(log: DataFrame, order: str = "seq", domain: str = "domain", hint: str = "hint") -> DataFrame:
    """The first known version hint of each domain."""
    return log.where(F.col(hint).isNotNull()).groupBy(domain).agg(F.min_by(hint, order).alias(hint))
