"""Column functions over raw html, URLs and response headers: all within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rscframe.kernel.flight import PUSH, RAW_FIRST_LINE

# Fixed values that pages are matched with.
NEXT_DATA = r"""(?s)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
ACTION_ID = r'createServerReference\)\("([0-9a-f]{16,64})"'
API_ROUTE = r"""fetch\(\s*["'](/api/[^"'?\s]+)"""
META = r"""(?i)<meta\s+(?:property|name)=["'](og:[\w:.-]+|twitter:[\w:.-]+)["']\s+content=["']([^"']*)["']"""
META_REVERSED = r"""(?i)<meta\s+content=["']([^"']*)["']\s+(?:property|name)=["'](og:[\w:.-]+|twitter:[\w:.-]+)["']"""
CHUNK_URL = r'src="([^"]*/_next/static/chunks/[^"]+\.js)"'
DIGEST = r'"digest"\s*:\s*"([a-zA-Z0-9_-]+)"'
BUILD_ID = "[?&]_rsc=([A-Za-z0-9_-]+)"
HTML_LANG = r"""(?i)<html[^>]+lang=["']([a-zA-Z0-9_-]+)["']"""
CHALLENGES = [
    ("cloudflare", r"(?i)cf-browser-verification|Attention Required! \| Cloudflare|cf-chl-|Just a moment\.\.\.|__cf_chl_"),
    ("akamai", r"(?i)akamai(?:ghost|-bot-manager)|_abck=|ak_bmsc"),
    ("datadome", r"(?i)datadome|dd_cookie_test_|geo\.captcha-delivery\.com"),
    ("perimeterx", r"(?i)_px3=|perimeterx|px-captcha"),
]
PROTECTION = r"(?i)_vercel_sso_nonce|vercel\.com/sso-api|Vercel Authentication|Authentication Required[\s\S]{0,200}Vercel"
BUNDLERS = [
    ("turbopack", ["__turbopack_require__", "__turbopack_context__", "/_next/static/chunks/[turbopack]"]),
    ("webpack", ["__webpack_require__", "webpackChunk_N_E", "self.webpackChunk"]),
]
VERSIONS = [
    ("13.0 - 13.3", ["self.__next_f.push"]),
    ("13.4 - 14.0", ["self.__next_f.push", ":HL["]),
    ("14.1 - 14.2", ["$@"]),
    ("15.0+", ["$Sreact.fragment", "$Sreact.suspense"]),
]
DRAFT_COOKIES = ["__prerender_bypass", "__next_preview_data"]
# fmt: off
LANGUAGES = [
    "aa", "ab", "ae", "af", "ak", "am", "an", "ar", "as", "av", "ay", "az", "ba", "be", "bg", "bh", "bi", "bm", "bn", "bo", "br", "bs", "ca", "ce", "ch",
    "co", "cr", "cs", "cu", "cv", "cy", "da", "de", "dv", "dz", "ee", "el", "en", "eo", "es", "et", "eu", "fa", "ff", "fi", "fj", "fo", "fr", "fy", "ga",
    "gd", "gl", "gn", "gu", "gv", "ha", "he", "hi", "ho", "hr", "ht", "hu", "hy", "hz", "ia", "id", "ie", "ig", "ii", "ik", "io", "is", "it", "iu", "ja",
    "jv", "ka", "kg", "ki", "kj", "kk", "kl", "km", "kn", "ko", "kr", "ks", "ku", "kv", "kw", "ky", "la", "lb", "lg", "li", "ln", "lo", "lt", "lu", "lv",
    "mg", "mh", "mi", "mk", "ml", "mn", "mr", "ms", "mt", "my", "na", "nb", "nd", "ne", "ng", "nl", "nn", "no", "nr", "nv", "ny", "oc", "oj", "om", "or",
    "os", "pa", "pi", "pl", "ps", "pt", "qu", "rm", "rn", "ro", "ru", "rw", "sa", "sc", "sd", "se", "sg", "si", "sk", "sl", "sm", "sn", "so", "sq", "sr",
    "ss", "st", "su", "sv", "sw", "ta", "te", "tg", "th", "ti", "tk", "tl", "tn", "to", "tr", "ts", "tt", "tw", "ty", "ug", "uk", "ur", "uz", "ve", "vi",
    "vo", "wa", "wo", "xh", "yi", "yo", "za", "zh", "zu",
]
# fmt: on


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def next_data(html: Column) -> Column:
    text = _got(html, NEXT_DATA)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def page_props(html: Column) -> Column:
    got = F.get_json_object(next_data(html), "$.props.pageProps")
    return F.when(got.startswith("{"), got)


def json_ld(html: Column, type: str | None = None) -> Column:
    """Array of JSON texts of linked-data objects, arrays flattened by a level."""
    texts = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    lists = F.transform(texts, lambda t: F.when(F.ltrim(t).startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(F.trim(t))))
    flat = F.filter(F.flatten(F.transform(lists, lambda x: F.coalesce(x, F.array().cast("array<string>")))), lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False)))
    if type is None:
        return flat
    return F.filter(flat, lambda t: (F.get_json_object(t, "$['@type']") == type) | F.coalesce(F.array_contains(F.from_json(F.get_json_object(t, "$['@type']"), "array<string>"), type), F.lit(False)))


def server_action_ids(html: Column) -> Column:
    return _all(html, ACTION_ID)


def api_routes(html: Column) -> Column:
    return _all(html, API_ROUTE)


def meta_tags(html: Column) -> Column:
    """Map of Open Graph and Twitter tags; the first wins, those with the property first before the others."""
    names = F.concat(F.regexp_extract_all(html, F.lit(META), F.lit(1)), F.regexp_extract_all(html, F.lit(META_REVERSED), F.lit(2)))
    values = F.concat(F.regexp_extract_all(html, F.lit(META), F.lit(2)), F.regexp_extract_all(html, F.lit(META_REVERSED), F.lit(1)))
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def chunk_urls(html: Column, pattern: str | None = None, base_path: str | None = None) -> Column:
    urls = _all(html, CHUNK_URL)
    if base_path is not None:
        urls = F.filter(urls, lambda u: u.startswith(base_path.rstrip("/") + "/_next/"))
    return urls if pattern is None else F.filter(urls, lambda u: u.rlike(pattern))


def base_path(html: Column) -> Column:
    return F.substring_index(F.regexp_extract(html, CHUNK_URL, 1), "/_next/static/chunks/", 1)


def build_id(html: Column) -> Column:
    return _got(html, BUILD_ID)


def locale(text: Column) -> Column:
    """From the html element, else a language code in the path or subdomain of the first URL."""
    url = F.coalesce(_got(text, r"""https?://[^\s"'<>]+""", 0), text)
    host = F.when(url.contains("://"), F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)).otherwise("")
    path = F.when(url.contains("://"), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)).otherwise(url)
    segment, sub = _got(path, r"^/([a-zA-Z]{2}(?:-[a-zA-Z]{2,4})?)(?=/|$)"), _got(host, r"^([a-zA-Z]{2})\.")
    known = lambda c: F.when(F.lower(F.substring_index(c, "-", 1)).isin(*LANGUAGES), c)
    return F.coalesce(_got(text, HTML_LANG), known(segment), known(sub))


def has_stream(html: Column) -> Column:
    """Whether a page holds push calls or is a row stream itself (see ``looks_raw`` of the kernel)."""
    line = F.substring_index(F.regexp_replace(html, r"^\s+", ""), "\n", 1)
    return html.contains(PUSH) | (line.rlike("^" + RAW_FIRST_LINE.pattern) & ~F.lower(F.substring(html, 1, 200)).contains("<html"))


def router(html: Column) -> Column:
    """app, pages, both, static_export or unknown."""
    data = html.rlike(NEXT_DATA)
    exported = F.get_json_object(_got(html, NEXT_DATA), "$.nextExport") == "true"
    return (
        F.when(has_stream(html) & data, "both").when(has_stream(html), "app").when(data & F.coalesce(exported, F.lit(False)), "static_export")
        .when(data, "pages").when(html.rlike(CHUNK_URL), "static_export").otherwise("unknown")
    )


def error_digest(html: Column) -> Column:
    return _got(html, DIGEST)


def _marked(html: Column, marks: list[str], all_: bool) -> Column:
    out = F.lit(all_)
    for m in marks:
        out = out & html.contains(m) if all_ else out | html.contains(m)
    return out


def bundler(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, marks in reversed(BUNDLERS):
        out = F.when(_marked(html, marks, False), name).otherwise(out)
    return out


def registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The known formats as a table: place, range, markers, notes; with a path, rows of JSON lines (range, markers, notes) in their order instead."""
    kind = "range string, markers array<string>, notes string"
    if path is None:
        rows = [(i, name, marks, None) for i, (name, marks) in enumerate(VERSIONS)]
        return spark.createDataFrame(rows, f"place long, {kind}")
    return spark.read.schema(kind).json(path).coalesce(1).select(F.monotonically_increasing_id().alias("place"), "*")


def known_versions(formats: DataFrame) -> list[tuple[str, list[str]]]:
    """A registry (a few rows) as what ``version_hint`` takes."""
    return [(r["range"], list(r["markers"] or [])) for r in formats.orderBy("place").collect()]


def version_hint(html: Column, versions: list[tuple[str, list[str]]] | None = None) -> Column:
    """The last range of the registry all of whose markers occur."""
    out = F.lit(None).cast("string")
    for name, marks in VERSIONS if versions is None else versions:
        out = F.when(_marked(html, marks, True), name).otherwise(out)
    return out


def challenge(html: Column, headers: Column | None = None) -> Column:
    text = F.substring(html, 1, 20_000)
    if headers is not None:
        text = F.concat_ws(" ", text, F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " "))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CHALLENGES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def deployment_protection(html: Column) -> Column:
    return html.rlike(PROTECTION)


def image_source(url: Column) -> Column:
    """The source of an image proxy URL; null if it is none."""
    return F.try_url_decode(_got(F.regexp_replace(url, "#.*$", ""), r"[?&]url=([^&]*)"))


def image_proxy(base: Column, image: Column, width: int, quality: int = 75) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/_next/image?url="), F.url_encode(image), F.lit(f"&w={width}&q={quality}"))


def srcset(text: Column) -> Column:
    """array<struct<width,url>> of the proxied candidates of a srcset."""
    parts = F.transform(F.split(text, r",\s+"), lambda p: F.struct(F.regexp_extract(p, r"\s(\d+)w\s*$", 1).try_cast("int").alias("width"), image_source(F.regexp_extract(p, r"^\s*(\S+)", 1)).alias("url")))
    return F.filter(parts, lambda p: p["url"].isNotNull())


# headers ----------------------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """A header by name in any case."""
    return F.try_element_at(F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.lit(name.lower()))


def _either(headers: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(header(headers, n), F.lit("")) for n in names])


def cache_status(headers: Column) -> Column:
    control = header(headers, "cache-control")
    return F.struct(header(headers, "x-nextjs-cache").alias("cache"), _got(control, r"s-maxage=(\d+)").try_cast("int").alias("s_maxage"), _got(control, r"stale-while-revalidate=(\d+)").try_cast("int").alias("stale_while_revalidate"), header(headers, "age").try_cast("int").alias("age"))


def rate_limits(headers: Column) -> Column:
    """retry_after (as it is sent: seconds or a date), retry_seconds where it is a number, remaining, reset."""
    after = header(headers, "retry-after")
    return F.struct(after.alias("retry_after"), F.trim(after).try_cast("long").alias("retry_seconds"), *[_either(headers, f"x-ratelimit-{x}", f"ratelimit-{x}").alias(x) for x in ("remaining", "reset")])


def edge_geo(headers: Column) -> Column:
    return F.struct(*[header(headers, f"x-vercel-ip-{x}").alias(x) for x in ("country", "city", "region")])


def middleware_rewrite(headers: Column) -> Column:
    return _either(headers, "x-middleware-rewrite", "x-nextjs-rewrite")


def cookie_names(set_cookie: Column) -> Column:
    return F.transform(set_cookie, lambda c: F.trim(F.split(c, "=")[0]))


def draft_mode(set_cookie: Column) -> Column:
    return F.coalesce(F.arrays_overlap(cookie_names(set_cookie), F.array(*map(F.lit, DRAFT_COOKIES))), F.lit(False))


def without_draft_cookies(set_cookie: Column) -> Column:
    return F.filter(set_cookie, lambda c: ~F.trim(F.split(c, "=")[0]).isin(*DRAFT_COOKIES))


def array_text(values: Column) -> Column:
    return F.array_join(values, ",")
