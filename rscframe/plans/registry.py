"""Queries over the driver's tables, one or more for each implemented family of operators.

Most encode base tables as pages, run the operator, and are held against SQL over the base tables.  A page has
the rows of a range of PER_PAGE keys, so that pages become more with the tables, not larger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rscframe.functions import normalize, pages as P
from rscframe.operators import health, search, tables
from rscframe.plans import synth
from rscframe.settings import CrawlConfig
from rscframe.sources import files, web

FLAGSHIP = "find_all_by_keys"
PER_PAGE = 50


def page_of(key: str, per: int = PER_PAGE):
    return F.floor(F.col(key) / per)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_pages(s: SparkSession, d: str) -> DataFrame:
    """50 parts a page as objects, each page with an element row and an early module and preload row."""
    p = _table(s, d, "part")
    obj = F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
    rows = p.select(page_of("p_partkey").alias("page"), F.col("p_partkey").alias("o"), synth.row(F.lower(F.hex("p_partkey")), obj).alias("row"))
    return synth.pages(rows, F.col("page"), ["o"], pushes=3)


def order_pages(s: SparkSession, d: str) -> DataFrame:
    """Orders that refer to a chunk of their customer and carry dates and big integers."""
    o, c = _table(s, d, "orders"), _table(s, d, "customer")
    page = page_of("o_custkey")
    obj = F.to_json(F.struct(F.concat(F.lit("$n"), F.col("o_orderkey").cast("string")).alias("order_key"), F.concat(F.lit("$D"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("placed"), F.col("o_totalprice").alias("total"), F.concat(F.lit("$c"), F.col("o_custkey").cast("string")).alias("customer")))
    orders = o.select(page.alias("page"), F.lit(0).alias("g"), F.col("o_orderkey").alias("o"), synth.row(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), obj).alias("row"))
    customers = c.select(page_of("c_custkey").alias("page"), F.lit(1).alias("g"), F.col("c_custkey").alias("o"), synth.row(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("row"))
    return synth.pages(orders.union(customers), F.col("page"), ["g", "o"], pushes=4)


def text_pages(s: SparkSession, d: str) -> DataFrame:
    """Each document a page of its own: its text as a byte-counted row, then an object."""
    t = _table(s, d, "documents").where("text is not null")
    row = F.concat(F.lit("1:T"), F.lower(F.hex(F.octet_length("text"))), F.lit(","), F.col("text"), F.lit('2:{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"body":"$1"}'))
    return synth.pages(t.select(F.col("doc_id").alias("page"), F.lit(0).alias("o"), row.alias("row")), F.col("page"), ["o"], pushes=2)


def doubled_pages(s: SparkSession, d: str) -> DataFrame:
    """Suppliers twice, the second time with another key order and under a repeated chunk id."""
    p = _table(s, d, "supplier")
    key = F.concat(F.lit("s"), (F.col("s_suppkey") % 5).cast("string"))
    page = page_of("s_suppkey", 10).alias("page")
    a = p.select(page, F.col("s_suppkey").alias("o"), F.lit(0).alias("g"), synth.row(key, F.to_json(F.struct("s_suppkey", "s_name"))).alias("row"))
    b = p.select(page, F.col("s_suppkey").alias("o"), F.lit(1).alias("g"), synth.row(key, F.to_json(F.struct("s_name", "s_suppkey"))).alias("row"))
    return synth.pages(a.union(b), F.col("page"), ["g", "o"])


def health_pages(s: SparkSession, d: str) -> DataFrame:
    """Customers' pages of good objects, raw tokens and cut objects."""
    c = _table(s, d, "customer")
    n = F.col("c_custkey") % 7
    body = F.when(n == 0, F.lit("oops")).when(n == 1, F.lit('"plain"')).when(n == 2, F.lit("[1,2]")).otherwise(F.to_json(F.struct("c_custkey", "c_acctbal")))
    rows = c.select(page_of("c_custkey").alias("page"), F.col("c_custkey").alias("o"), synth.row(F.lower(F.hex("c_custkey")), body).alias("row"))
    return synth.pages(rows, F.col("page"), ["o"])


def fetch_log(s: SparkSession, d: str) -> DataFrame:
    e = _table(s, d, "events")
    return e.select(F.col("event_type").alias("domain"), F.col("event_id").alias("seq"), (F.pmod(F.col("event_id") * 7919, F.lit(1024)) / 1024.0).alias("score"), F.when(F.col("user_id") % 11 == 0, 0).otherwise(5).alias("n_chunks"), (F.col("event_id") % 3).cast("int").alias("attempt"))


def marked_pages(s: SparkSession, d: str) -> DataFrame:
    """Html with markers, tags, routes and URLs that depend on the supplier."""
    p, k = _table(s, d, "supplier"), F.col("s_suppkey").cast("string")
    n = F.col("s_suppkey") % 6
    mark = (
        F.when(n == 0, F.lit('<script>self.__next_f.push([1,"0:{}"])</script>')).when(n == 1, F.lit('<script>self.__next_f.push([1,":HL[1]"])</script>'))
        .when(n == 2, F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"a":1}}}</script>'))
        .when(n == 3, F.lit('<script src="/docs/_next/static/chunks/main-1.js"></script><script>self.webpackChunk_N_E=[]</script>'))
        .when(n == 4, F.lit('<script id="__NEXT_DATA__" type="application/json">{"nextExport":true}</script>')).otherwise(F.lit("<p>Just a moment...</p>"))
    )
    html = F.concat(F.lit('<html><head><meta property="og:title" content="'), F.col("s_name"), F.lit('"><meta content="'), k, F.lit('" name="twitter:site">'), F.lit('<script type="application/ld+json">{"@type":"Product","sku":"'), k, F.lit('"}</script></head><body>fetch("/api/s/'), k, F.lit('") fetch("/api/s/'), k, F.lit('") createServerReference)("'), F.md5(k.cast("binary")), F.lit('" "digest":"d'), k, F.lit('" '), mark, F.lit("</body></html>"))
    return p.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))




def q_find_all_by_keys(s, d):
    found = search.find_all_by_keys(part_pages(s, d), ["p_partkey", "p_retailprice"])
    return search.as_records(found, "p_partkey long, p_name string, p_retailprice double", "page_id")


def q_find_any_keys(s, d):
    return search.as_records(search.find_any_keys(part_pages(s, d), ["p_brand", "nothing"]), "p_partkey long, p_brand string")


def q_find_by_key_pattern(s, d):
    return search.as_records(search.find_by_key_pattern(part_pages(s, d), "^p_re.*ice$"), "p_partkey long")


def q_find_by_type(s, d):
    return search.as_records(search.find_by_type(part_pages(s, d), 7, key="p_size"), "p_partkey long, p_size int")


def q_find_all_predicate(s, d):
    return search.as_records(search.find_all(part_pages(s, d), lambda v: isinstance(v, dict) and v.get("p_retailprice", 0) > 950), "p_partkey long")


def q_find_by_keys_first(s, d):
    return search.as_records(search.find_by_keys(part_pages(s, d), ["p_partkey"]), "p_partkey long", "page_id")


def q_find_all_by_keys_dedupe(s, d):
    return search.as_records(search.find_all_by_keys(doubled_pages(s, d), ["s_suppkey"], dedupe=True), "s_suppkey long, s_name string", "page_id")


def q_find_text(s, d):
    return search.find_text(part_pages(s, d), "^Brand#1").select("page_id", "text")


def q_chunk_keys(s, d):
    return tables.chunks(doubled_pages(s, d), columns=["chunk_key", "chunk_id", "kind", "value_type"])


def q_resolve_references(s, d):
    r = tables.resolved(order_pages(s, d)).where("chunk_key like 'o%'")
    return r.select("page_id", F.from_json("value_json", "order_key long, placed string, total double, customer struct<c_custkey:long,c_name:string,c_mktsegment:string>").alias("v")).select("page_id", "v.order_key", F.to_timestamp("v.placed").cast("timestamp_ntz").alias("placed"), "v.total", "v.customer.c_custkey", "v.customer.c_name", "v.customer.c_mktsegment")


def q_text_rows(s, d):
    c = tables.chunks(text_pages(s, d), columns=["kind", "raw", "status"]).where("kind = 'text'")
    return c.select(F.col("page_id").alias("doc_id"), F.length("raw").cast("long").alias("n_chars"), F.md5(F.col("raw").cast("binary")).alias("digest"), "status")


def q_text_reference(s, d):
    r = tables.projected(text_pages(s, d), ["2.doc_id", "2.body", "2.none"])
    return r.select(F.col("p0").cast("long").alias("doc_id"), F.md5(F.from_json(F.concat(F.lit('{"a":'), F.col("p1"), F.lit("}")), "a string")["a"].cast("binary")).alias("digest"), F.col("p2").alias("missing"))


def q_nodes(s, d):
    n = tables.nodes(part_pages(s, d), columns=["depth", "ntype", "first_visit", "sval"])
    return n.groupBy("depth", "ntype").agg(F.count("*").alias("n"), F.count_if("first_visit").alias("n_first"), F.count("sval").alias("n_scalar"))


def q_page_stats(s, d):
    p = health_pages(s, d)
    st = health.stats(p)
    return st.select("page_id", "chunk_count", "json_chunk_count", "type_str", "type_dict", "type_list")


def q_parse_confidence(s, d):
    p = health_pages(s, d)
    return health.confidence(p).select("page_id", "n_judged", "n_raw", F.round("score", 6).alias("score"))


def listed_pages(s, d, changed: bool):
    """Parts as one list of objects a page, with tags; the changed crawl lacks some, has others, and other prices and tags."""
    p = _table(s, d, "part").select("p_partkey", "p_retailprice")
    p = p.where("p_partkey % 11 <> 0").withColumn("p_retailprice", F.expr("p_retailprice + if(p_partkey % 7 = 0, 1.0, 0.0)")) if changed else p.where("p_partkey % 13 <> 0")
    tags = F.when((F.col("p_partkey") % 5 == 0) & F.lit(changed), F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    item = F.to_json(F.struct(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), tags.alias("tags")))
    one = p.groupBy(page_of("p_partkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), ",").alias("items"))
    row = F.concat(F.lit('0:{"items":['), F.col("items"), F.lit("]}"))
    return synth.pages(one.select("page", F.lit(0).alias("o"), row.alias("row")), F.col("page"), ["o"])


def q_page_diff(s, d):
    def pages(changed):
        p = _table(s, d, "part").select("p_partkey", "p_retailprice")
        if changed:
            p = p.where("p_partkey % 11 <> 0").withColumn("p_retailprice", F.expr("p_retailprice + if(p_partkey % 7 = 0, 1.0, 0.0)"))
        else:
            p = p.where("p_partkey % 13 <> 0")
        rows = p.select(page_of("p_partkey").alias("page"), F.col("p_partkey").alias("o"), synth.row(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), F.to_json(F.struct("p_retailprice"))).alias("row"))
        return synth.pages(rows, F.col("page"), ["o"])

    return search.diff(pages(False), pages(True)).select("page_id", "path", "change")


def q_page_diff_lists(s, d):
    return search.diff(listed_pages(s, d, False), listed_pages(s, d, True)).select("page_id", "path", "change")


def q_page_diff_keyed(s, d):
    return search.diff(listed_pages(s, d, False), listed_pages(s, d, True), id_key="k").select("page_id", "path", "change")


def q_flat(s, d):
    return tables.flat(listed_pages(s, d, False)).select("page_id", "path", F.col("value_json").alias("value"))


def q_throttle(s, d):
    return health.throttled(fetch_log(s, d), window=6, least=0.45).select("domain", "seq", F.round("rolling", 6).alias("rolling"), "throttled", "step")


def q_drift(s, d):
    return health.drifted(fetch_log(s, d)).select("domain", "seq", F.round("mean_before", 6).alias("mean_before"))


def q_running_confidence(s, d):
    return health.running_confidence(fetch_log(s, d)).select("domain", "seq", "avg_confidence")


def q_crawl_stats(s, d):
    return health.crawl_stats(fetch_log(s, d))


def hinted_log(s, d):
    n = F.col("seq") % 4
    return fetch_log(s, d).withColumn("hint", F.when(n == 0, "13.0").when(n == 1, "15.0+")).withColumn("stopped", F.col("seq") % 10 == 0)


def q_crawl_hints(s, d):
    st = health.crawl_stats(hinted_log(s, d), hint="hint", stopped="stopped")
    return st.select("with_data", "stopped_early", *[F.col("version_hints")[k].alias(n) for k, n in (("13.0", "n_13"), ("15.0+", "n_15"), ("unknown", "n_unknown"))])


def q_first_hints(s, d):
    return health.first_hints(hinted_log(s, d))


def q_retries(s, d):
    return health.retries(fetch_log(s, d), vendor=None).select("domain", "seq", "attempt")


def q_crawl_dedupe(s, d):
    e = _table(s, d, "events").select(F.col("event_id").alias("seq"), F.to_json(F.struct("user_id", "event_type")).alias("item_json"))
    return search.crawl_deduped(e, "seq").select("seq")


def q_locale(s, d):
    p = _table(s, d, "pages")
    return p.select("page_id", P.locale(F.col("html")).alias("locale"), P.locale(F.col("url")).alias("url_locale"), P.router(F.col("html")).alias("router"))


def q_markers(s, d):
    h = F.col("html")
    m = marked_pages(s, d)
    return m.select(
        "page_id", P.router(h).alias("router"), P.version_hint(h).alias("version"), P.bundler(h).alias("bundler"), P.challenge(h).alias("challenge"), P.base_path(h).alias("base_path"),
        P.error_digest(h).alias("digest"), P.array_text(P.api_routes(h)).alias("routes"), P.array_text(P.server_action_ids(h)).alias("actions"), P.meta_tags(h)["og:title"].alias("title"), P.meta_tags(h)["twitter:site"].alias("site"),
        F.get_json_object(P.json_ld(h, "Product")[0], "$.sku").alias("sku"), P.page_props(h).alias("props"),
    )


def q_redact(s, d):
    return _table(s, d, "documents").select("doc_id", F.md5(normalize.redact(F.col("text")).cast("binary")).alias("digest"))


def q_domain(s, d):
    return _table(s, d, "pages").select("page_id", normalize.domain(F.col("url")).alias("domain"))


def q_price(s, d):
    p = _table(s, d, "part")
    v = normalize.price(F.concat(F.lit("€ "), F.format_string("%,.2f", F.col("p_retailprice"))))
    w = normalize.price(F.concat(F.format_string("%.2f", F.col("p_retailprice")), F.lit(" USD")))
    return p.select("p_partkey", v["amount"].alias("amount"), v["currency"].alias("currency"), w["amount"].alias("plain"), w["currency"].alias("plain_currency"))


def q_dates(s, d):
    o, t = _table(s, d, "orders"), F.col("o_orderdate")
    forms = [F.date_format(t, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy")]
    return o.select("o_orderkey", *[F.to_date(normalize.date(f)).alias(f"d{i}") for i, f in enumerate(forms)])


def q_image_urls(s, d):
    u = P.image_proxy(F.lit("https://x.example/"), F.col("url"), 640)
    return _table(s, d, "pages").select("page_id", P.image_source(u).alias("url"), P.srcset(F.concat(u, F.lit(" 640w, /a.png 1x")))[0]["width"].alias("width"))


def q_cache_headers(s, d):
    h = F.create_map(F.lit("X-Nextjs-Cache"), F.when(F.col("s_suppkey") % 2 == 0, "HIT").otherwise("STALE"), F.lit("Cache-Control"), F.concat(F.lit("s-maxage="), F.col("s_suppkey").cast("string"), F.lit(", stale-while-revalidate=60")), F.lit("AGE"), F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_suppkey").cast("string")))
    c = F.array(F.lit("a=1; Path=/"), F.when(F.col("s_suppkey") % 4 == 0, "__prerender_bypass=1").otherwise("b=2"))
    st = P.cache_status(h)
    return _table(s, d, "supplier").select("s_suppkey", st["cache"].alias("cache"), st["s_maxage"].alias("s_maxage"), st["stale_while_revalidate"].alias("swr"), st["age"].alias("age"), P.draft_mode(c).alias("draft"), F.size(P.without_draft_cookies(c)).alias("n_cookies"))


def supplier_pages(s, d):
    """A page a supplier: its address as a chunk of its own, in an entry, in a list, repeated, and not quite."""
    p, k = _table(s, d, "supplier"), F.col("s_suppkey").cast("string")
    rows = [
        F.concat(F.lit('0:"/s/'), k, F.lit('"')),
        F.concat(F.lit('1:{"href":"https://x.example/'), k, F.lit('","again":"/s/'), k, F.lit('","list":["/no/'), k, F.lit('"],"root":"/","text":"a /b","@slot":"../up/'), k, F.lit('"}')),
        F.concat(F.lit('2:{"next":"p/'), k, F.lit('","link":"/t/'), k, F.lit('?q=1"}')),
    ]
    row = F.concat_ws("\n", *rows)
    return synth.pages(p.select(F.col("s_suppkey").alias("page"), F.lit(0).alias("o"), row.alias("row")), F.col("page"), ["o"]).withColumn("url", F.concat(F.lit("https://s.example/a/"), F.col("page_id").cast("string")))


def q_find_urls(s, d):
    return search.find_urls(supplier_pages(s, d)).select("page_id", F.col("ord").cast("int").alias("ord"), "url")


def q_find_urls_keys(s, d):
    return search.find_urls(supplier_pages(s, d), keys=["href", "0", "link"], pattern="^/|/1").select("page_id", "url")


def q_follow_urls(s, d):
    return search.follow_urls(supplier_pages(s, d), pattern="^/", id="url").select(F.regexp_extract("target", "/[st]/([0-9]+)", 1).cast("long").alias("s_suppkey"), "link", "target")


def q_similar_keys(s, d):
    return search.similar_keys(part_pages(s, d), ["p_nane", "retailprice", "zzz"], most=1).select("page_id", "wanted", "key")


def paged_pages(s, d):
    """Pages of customers, with the several shapes of cursors."""
    c, k = _table(s, d, "customer"), F.col("c_custkey").cast("string")
    n = F.col("c_custkey") % 6
    weak, mid, best = F.concat(F.lit('{"endCursor":"e'), k, F.lit('"}')), F.concat(F.lit('{"hasNextPage":true,"cursor":"c'), k, F.lit('"}')), F.concat(F.lit('{"hasNextPage":false,"endCursor":"b'), k, F.lit('"}'))
    body = F.when(n == 0, F.concat(F.lit("["), weak, F.lit(","), mid, F.lit(","), best, F.lit("]"))).when(n == 1, F.concat(F.lit("["), weak, F.lit(","), mid, F.lit("]"))).when(n == 2, weak).when(n == 3, F.concat(F.lit('{"a":{"nextCursor":"n'), k, F.lit('"}}'))).otherwise(F.lit("{}"))
    return synth.pages(c.select(F.col("c_custkey").alias("page"), F.lit(0).alias("o"), F.concat(F.lit("0:"), body).alias("row")), F.col("page"), ["o"])


def q_find_pagination(s, d):
    p = search.find_pagination(paged_pages(s, d))
    return p.select("page_id", F.col("preference").cast("int").alias("preference"), F.coalesce(*[F.get_json_object("value_json", f"$.{k}") for k in ("endCursor", "cursor", "nextCursor")]).alias("cursor"))


def q_shapes(s, d):
    return tables.shapes(listed_pages(s, d, False)).select("page_id", "chunk_key", "shape")


def mixed_pages(s, d):
    """Each document a page: as html text, as plain text, and an object and a list beside them."""
    t = _table(s, d, "documents").where("text is not null")
    html = F.concat(F.lit("<p>"), F.substring("text", 1, 40), F.lit("</p>"))
    row = F.concat(*[F.concat(F.lit(f"{k}:T"), F.lower(F.hex(F.octet_length(c))), F.lit(","), c) for k, c in (("1", html), ("2", F.col("lang")))], F.lit('3:{"id":'), F.col("doc_id").cast("string"), F.lit('}\n4:[]\n5:"s"\n6:I["m"]\n7:12'))
    return synth.pages(t.where("lang is not null").select(F.col("doc_id").alias("page"), F.lit(0).alias("o"), row.alias("row")), F.col("page"), ["o"])


def q_keys_of(s, d):
    p = mixed_pages(s, d)
    some = [tables.keys_of(p, w).select("page_id", F.array_join("keys", ",").alias(f"{w}_keys")) for w in ("json", "text", "html")]
    out = tables.keys_of(p).select("page_id", F.array_join("keys", ",").alias("keys"), F.col("n").cast("int").alias("n"))
    for x in some:
        out = out.join(x, "page_id")
    return out


def q_resolved_some(s, d):
    p = mixed_pages(s, d)
    parts = [tables.resolved(p, which=w).select("page_id", F.lit(w).alias("which"), "chunk_key", "value_type") for w in ("json", "text", "html")]
    return parts[0].union(parts[1]).union(parts[2])


def q_with_chunk(s, d):
    p = mixed_pages(s, d)
    a, b = tables.with_chunk(p, "3"), tables.with_chunk(p, "9")
    return a.select("page_id", F.col("has").alias("has_3"), F.col("kind").alias("kind_3"), F.get_json_object("value_json", "$.id").cast("long").alias("doc_id")).join(b.select("page_id", F.col("has").alias("has_9")), "page_id")


def truncated_pages(s, d):
    """Objects that are cut off: in a string, after a key, in a word."""
    c, k = _table(s, d, "customer"), F.col("c_custkey").cast("string")
    n = F.col("c_custkey") % 3
    body = F.concat(F.lit('{"k":'), k, F.lit(',"name":"'), F.col("c_name"), F.when(n == 0, F.lit('","list":["x","y')).when(n == 1, F.lit('","rest":')).otherwise(F.lit('","flag":tru')))
    return synth.pages(c.select(F.col("c_custkey").alias("page"), F.lit(0).alias("o"), F.concat(F.lit("0:"), body).alias("row")), F.col("page"), ["o"])


def q_repair(s, d):
    r = tables.chunks(truncated_pages(s, d), repair=True, columns=["status", "value_json"])
    v = F.from_json("value_json", "k long, name string, list array<string>")
    return r.select("status", v["k"].alias("c_custkey"), v["name"].alias("c_name"), F.array_join(v["list"], ",").alias("list"))


def q_not_repaired(s, d):
    return tables.chunks(truncated_pages(s, d), columns=["status", "value_type"]).groupBy("status", "value_type").agg(F.count("*").alias("n"))


def streamed_pages(s, d):
    """Suppliers in three pushes: a shell, half of the rows, and the others; odd ones have a placeholder."""
    p, k = _table(s, d, "supplier"), F.col("s_suppkey").cast("string")
    shell = F.concat(F.lit('0:{"k":'), k, F.when(F.col("s_suppkey") % 2 == 1, F.lit(',"late":"$@2"')).otherwise(F.lit("")), F.lit("}\n"))
    pushes = [shell, F.lit('1:{"a":1}\n2:{"b":2}\n'), F.lit('3:{"c":3}\n')]
    calls = [F.concat(F.lit("<script>self.__next_f.push([1,"), synth._quoted(x), F.lit("])</script>")) for x in pushes]
    return p.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("<html>"), calls[0], F.when(F.col("s_suppkey") % 4 != 0, F.concat(*calls[1:])).otherwise(F.lit("")), F.lit("</html>")).alias("html"))


def q_streamed(s, d):
    return health.streamed(streamed_pages(s, d)).select("page_id", F.array_join("static_chunks", ",").alias("static_chunks"), F.array_join("dynamic_chunks", ",").alias("dynamic_chunks"), "is_ppr")


def q_push_indexes(s, d):
    return health.push_indexes(streamed_pages(s, d)).select("page_id", "chunk_id", F.col("push_idx").cast("int").alias("push_idx"))


def q_skeletons(s, d):
    return health.fallback_skeletons(streamed_pages(s, d))


def q_raw_streams(s, d):
    """Row streams without html, and texts that only look like them."""
    p, k = _table(s, d, "supplier"), F.col("s_suppkey").cast("string")
    n = F.col("s_suppkey") % 4
    body = F.when(n == 0, F.concat(F.lit('0:{"k":'), k, F.lit("}"))).when(n == 1, F.concat(F.lit("name: "), k)).when(n == 2, F.concat(F.lit("<html>0:{"), k)).otherwise(F.concat(F.lit("a:"), k))
    pages = p.select(F.col("s_suppkey").alias("page_id"), body.alias("html"))
    return pages.join(tables.keys_of(pages), "page_id").select("page_id", F.col("n").cast("int").alias("n"), P.has_stream(F.col("html")).alias("is_stream"))


def q_segments(s, d):
    n = F.col("s_suppkey") % 5
    seg = F.when(n == 0, F.concat(F.lit("@"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")))).when(n == 1, F.lit("(.)")).when(n == 2, F.lit("(..)(..)")).when(n == 3, F.lit("(group)")).otherwise(F.lit("@ a"))
    return _table(s, d, "supplier").select("s_suppkey", search.is_slot_key(seg).alias("is_slot"), search.is_intercepting_segment(seg).alias("is_intercepting"))


def q_chunk_urls(s, d):
    k = F.col("s_suppkey").cast("string")
    src = lambda path: F.concat(F.lit('<script src="'), path, F.lit('"></script>'))
    html = F.concat(src(F.concat(F.lit("/docs/_next/static/chunks/"), k, F.lit(".js"))), src(F.lit("/_next/static/chunks/main.js")), src(F.concat(F.lit("/docs/_next/static/chunks/"), k, F.lit(".js"))), src(F.lit("/other.js")))
    return _table(s, d, "supplier").select("s_suppkey", P.array_text(P.chunk_urls(html)).alias("urls"), P.array_text(P.chunk_urls(html, base_path="/docs/")).alias("docs"), P.array_text(P.chunk_urls(html, pattern="main")).alias("main"), P.build_id(F.concat(F.lit('href="/x?a=1&_rsc='), k, F.lit('"'))).alias("build_id"))


def q_protection(s, d):
    n = F.col("s_suppkey") % 4
    html = F.when(n == 0, F.lit("<a href='https://vercel.com/sso-api?x'>")).when(n == 1, F.concat(F.lit("Authentication Required\n"), F.col("s_name"), F.lit(" Vercel"))).when(n == 2, F.lit("authentication required")).otherwise(F.col("s_name"))
    return _table(s, d, "supplier").select("s_suppkey", P.deployment_protection(html).alias("protected"))


def q_response_headers(s, d):
    n, k = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    h = F.create_map(
        F.lit("RETRY-After"), F.when(n == 0, k).otherwise("Wed, 21 Oct 2026 07:28:00 GMT"), F.lit("X-RateLimit-Remaining"), F.when(n == 1, "").otherwise(k), F.lit("ratelimit-remaining"), F.lit("7"), F.lit("RateLimit-Reset"), k,
        F.lit("x-vercel-ip-country"), F.lit("DE"), F.lit("X-Vercel-IP-City"), k, F.lit("x-middleware-rewrite"), F.when(n == 2, "").otherwise("/to"), F.lit("x-nextjs-rewrite"), F.lit("/else"),
    )
    r, g = P.rate_limits(h), P.edge_geo(h)
    return _table(s, d, "supplier").select("s_suppkey", r["retry_after"].alias("retry_after"), r["retry_seconds"].alias("retry_seconds"), r["remaining"].alias("remaining"), r["reset"].alias("reset"), g["country"].alias("country"), g["city"].alias("city"), g["region"].alias("region"), P.middleware_rewrite(h).alias("rewrite"))


def q_clean_text(s, d):
    t = F.concat(F.lit(" a&amp;b&nbsp;&eacute;"), F.regexp_replace("text", "&", "&amp;"), F.lit("\t\n &#x41; "))
    return _table(s, d, "documents").where("text is not null").select("doc_id", F.md5(normalize.clean_text(t).cast("binary")).alias("digest"))


@dataclass
class Part:
    p_partkey: int
    p_name: str
    p_retailprice: float
    p_size: int | None = None
    tags: list[str] | None = None


def q_extract_as(s, d):
    return search.extract_as(part_pages(s, d), Part, keys=["p_partkey", "p_name", "p_retailprice"]).select("page_id", "p_partkey", "p_name", "p_retailprice", F.col("p_size").cast("int").alias("p_size"), F.array_join("tags", ",").alias("tags"))


def q_extract_as_missing(s, d):
    return search.extract_as(health_pages(s, d), Part, keys=["c_custkey"], on_missing="mark").select("page_id", F.array_join("missing", ",").alias("missing"))


def q_records(s, d):
    return search.records(part_pages(s, d), "p_partkey long, p_type string", keys=["p_type"])


def q_find_one(s, d):
    return search.as_records(search.find_one(part_pages(s, d), lambda v: isinstance(v, dict) and v.get("p_size", 0) > 25), "p_partkey long, p_size int", "page_id")


def q_pipeline_matches(s, d):
    config = CrawlConfig(pipeline_keys=("s_suppkey", "s_name"), dedupe=True)
    return search.as_records(search.pipeline_matches(doubled_pages(s, d), config), "s_suppkey long, s_name string", "page_id")


def q_page_objects(s, d):
    v = F.from_json("value", "map<string,struct<s_suppkey:long,s_name:string>>")
    return files.page_objects(doubled_pages(s, d)).select("page_id", F.explode(v)).select("page_id", F.col("key").alias("chunk_key"), "value.s_suppkey", "value.s_name")


def q_csv_records(s, d):
    return files.flat_records(search.find_all_by_keys(part_pages(s, d), ["p_type"])).select("p_partkey", "p_brand", "p_type")


def q_stream_requests(s, d):
    p = _table(s, d, "pages").withColumn("flag", F.when(F.col("page_id") % 5 == 0, False).when(F.col("page_id") % 5 == 1, True)).withColumn("headers", F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("next-url"), F.lit("/own"))))
    got = web.stream_requests(p, flag="flag", config=CrawlConfig(rsc_url_pattern="[02468]$"))
    h = F.col("headers")
    return got.select("page_id", "stream", P.header(h, "RSC").alias("rsc"), P.header(h, "Next-Url").alias("next_url"))


def q_action_meta(s, d):
    m = web.read_action_meta(F.when(F.col("s_suppkey") % 3 != 0, web.action_meta(F.col("s_name"), cursor=F.col("s_suppkey"))))
    return _table(s, d, "supplier").select("s_suppkey", F.try_element_at(m, F.lit("action_id")).alias("action_id"), F.try_element_at(m, F.lit("cursor")).alias("cursor"), F.size(m).alias("n"))


def q_version_registry(s, d):
    known = P.known_versions(P.registry(s))
    m = marked_pages(s, d)
    return m.select("page_id", P.version_hint(F.col("html"), known).alias("version"), P.version_hint(F.col("html"), [("any", ["digest"]), ("none", ["digest", "no such mark"])]).alias("own"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
