"""Pages over HTTP: rows of URLs in, rows of responses out, fetched by the executors.

``fetched`` takes GET requests, ``sessions`` keeps cookies and router trees from one request of a session to the next, ``acted``
posts server actions; ``stream_requests`` marks the requests that shall ask for row streams.  A request that fails is a row with ``error`` set; no request ends a job.  A partition
that is lost is fetched again, and its actions are posted again.  Each task has at most ``at_once`` requests under way, and holds no more bodies than that.
"""

from __future__ import annotations

import gzip
import http.cookiejar
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zlib
from collections import deque
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rscframe.functions.pages import BUILD_ID, DRAFT_COOKIES
from rscframe.kernel.flight import MISSING

AGENT = {"User-Agent": "Mozilla/5.0 (rscframe)"}
RESPONSE = "status int, headers map<string,string>, set_cookie array<string>, html string, fetched_at timestamp, error string"
FILES = "array<struct<filename:string,data:binary>>"
ROUTER_TREE = '["", {}, null, null, true]'  # fixed value: the tree of a route of one segment
STALE_ACTION = "Failed to find Server Action"  # fixed value: what a server says of an action id that it does not know


def decoded(body: bytes, encoding: str | None, charset: str | None) -> str:
    """The text of a response body; what cannot be decoded becomes replacement characters."""
    kind = (encoding or "").strip().lower()
    if kind in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    elif kind == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -zlib.MAX_WBITS)
    elif kind == "br":
        import brotli  # optional

        body = brotli.decompress(body)
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def requested(opener, url: str, headers: dict, timeout: float, data: bytes | None = None) -> tuple:
    """A row of RESPONSE; the body of an error response is kept."""
    status, got, cookies, text, error = None, {}, [], None, None
    at = int(time.time() * 1e6)
    try:
        if not url.lower().startswith(("http://", "https://")):
            raise ValueError("no http address")  # an opener would also read local files
        try:
            reply = opener.open(urllib.request.Request(url, data=data, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            reply, error = e, f"HTTP {e.code}"
        with reply:
            status, got = reply.status, {k: v for k, v in reply.headers.items() if k.lower() != "set-cookie"}
            cookies = reply.headers.get_all("Set-Cookie") or []
            text = decoded(reply.read(), reply.headers.get("Content-Encoding"), reply.headers.get_content_charset())
    except Exception as e:  # whatever a server or an address may do, it is this row's error
        error = f"{type(e).__name__}: {e}"[:500]
    return status, list(got.items()), cookies, text, at, error


def with_query(url: str, name: str, value: str) -> str:
    return f"{url}{'&' if '?' in url else '?'}{name}={value}"


def stream_headers(url: str) -> dict:
    return {"RSC": "1", "Accept": "*/*", "Accept-Encoding": "identity", "Next-Url": urllib.parse.urlparse(url).path or "/"}


def get(opener, url: str, mode: str, timeout: float, headers: dict, discover: bool) -> tuple:
    """A page, or with mode ``stream`` its row stream; the build id is looked for in the page first."""
    own = {}
    if mode == "stream":
        if discover and "_rsc=" not in url:
            import re

            found = re.search(BUILD_ID, requested(opener, url, {**AGENT, "Accept-Encoding": "identity"}, timeout)[3] or "")
            url = with_query(url, "_rsc", found[1]) if found else url
        own = stream_headers(url)
    return requested(opener, url, {**AGENT, **own, **headers}, timeout)


def _headers(headers: dict | None, cookies: dict | None) -> dict:
    return {**(headers or {}), **({"Cookie": "; ".join(f"{k}={v}" for k, v in cookies.items())} if cookies else {})}


def _responses(rows: DataFrame, schema: str, call, at_once: int, transport=None) -> DataFrame:
    """``call(opener, *row)`` of every row, after the row's first column; in order, with a bounded number under way.

    ``transport`` makes a task's opener (see ``default_transport``), for proxies, retries or another client.
    """
    first = rows.schema[0]
    full = f"{first.name} {first.dataType.simpleString()}, {schema}"
    described = rows.sparkSession.createDataFrame([], full).schema.jsonValue()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        target = to_arrow_schema(StructType.fromJson(described))
        opener = (transport or default_transport)()

        def one(key, reply):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, *reply), target)], schema=target)

        with ThreadPoolExecutor(at_once) as pool:
            under_way: deque = deque()
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    under_way.append((row[0], pool.submit(call, opener, *row)))
                    if len(under_way) >= at_once:
                        key, reply = under_way.popleft()
                        yield one(key, reply.result())
            for key, reply in under_way:
                yield one(key, reply.result())

    return rows.mapInArrow(run, full)


def fetched(df: DataFrame, mode: str = "page", timeout: float = 15.0, headers: dict | None = None, cookies: dict | None = None, discover: bool = True, at_once: int = 8, url: str = "url", transport=None) -> DataFrame:
    """url and RESPONSE of every row; ``mode`` is page or stream."""
    if mode not in ("page", "stream"):
        raise ValueError("mode is page or stream")
    sent = _headers(headers, cookies)
    return _responses(df.select(url), RESPONSE, lambda o, u: get(o, u, mode, timeout, sent, discover), at_once, transport)


def default_transport(cookies: bool = False):
    """An opener: anything with ``open(request, timeout=)`` that returns a response with status, headers and read()."""
    return urllib.request.build_opener(*([urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar())] if cookies else []))


def route(url: str) -> str:
    return urllib.parse.urlsplit(url).path or "/"


def _drop_cookies(opener, names: list[str]) -> None:
    for handler in getattr(opener, "handlers", []):
        if isinstance(handler, urllib.request.HTTPCookieProcessor):
            for c in [c for c in handler.cookiejar if c.name in names]:
                handler.cookiejar.clear(c.domain, c.path, c.name)


def sessions(df: DataFrame, order: str, session: str | None = None, timeout: float = 15.0, headers: dict | None = None, mode: str = "page", url: str = "url", strip_draft_cookies: bool = True, transport=None, config=None) -> DataFrame:
    """Requests that follow one another within a session (a host, unless a column is named): url, RESPONSE, router_tree.

    Cookies are handed on, draft-mode cookies taken away after each page unless ``strip_draft_cookies`` is false.  A row with an
    ``action_id`` (and ``args``, ``files``, ``router_tree``, where there are such columns) posts a server action with the session's cookies, and with the
    router tree given, else that which the session last used on the route, else the usual one.  A session is one task, as each request needs the one before.
    """
    strip = config.strip_draft_cookies if config is not None else strip_draft_cookies
    have = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    rows = df.select(F.col(url).alias("url"), (F.col(session).cast("string") if session else F.try_parse_url(url, F.lit("AUTHORITY"))).alias("_session"), have("action_id", "string").alias("action_id"), have("args", "string").alias("args"), have("router_tree", "string").alias("router_tree"), have("files", FILES).alias("files"), F.col(order).alias("_order"))
    rows = rows.repartition("_session").sortWithinPartitions("_session", "_order").drop("_order")
    sent = _headers(headers, None)
    make = transport or (lambda: default_transport(True))
    state: dict = {}

    def call(_, address, name, action, args, tree, files):
        if state.get("name", MISSING) != name:
            state.clear()
            state.update(name=name, opener=make(), trees={})
        opener, trees = state["opener"], state["trees"]
        if action is None:
            reply = get(opener, address, mode, timeout, sent, False)
            if strip:
                _drop_cookies(opener, DRAFT_COOKIES)
            used = ROUTER_TREE
        else:
            used = tree or trees.get(route(address)) or ROUTER_TREE
            reply = act(opener, address, action, args, files, used, sent, timeout)
        trees[route(address)] = used
        return (*reply, used)

    return _responses(rows, RESPONSE + ", router_tree string", call, 1, transport)


def action_body(args: list, files: list | None = None) -> tuple[bytes, str]:
    """Body and content type of an action's arguments: a JSON array, or parts named 0, 1, ... where there are files."""
    if not files:
        return json.dumps(args, ensure_ascii=False).encode(), "text/plain;charset=UTF-8"
    mark = uuid.uuid4().hex
    parts = [("", "", (a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)).encode()) for a in args]
    parts += [(f'; filename="{f["filename"]}"', "\r\nContent-Type: application/octet-stream", bytes(f["data"])) for f in files]
    body = b"".join(f'--{mark}\r\nContent-Disposition: form-data; name="{i}"{name}{kind}\r\n\r\n'.encode() + data + b"\r\n" for i, (name, kind, data) in enumerate(parts))
    return body + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def act(opener, url: str, action: str, args: str | None, files: list | None, tree: str, headers: dict, timeout: float) -> tuple:
    """A row of RESPONSE to a posted action."""
    body, kind = action_body(json.loads(args or "[]"), files)
    own = {"Next-Action": action, "Next-Router-State-Tree": urllib.parse.quote(tree), "Accept": "text/x-component", "Content-Type": kind}
    reply = requested(opener, url, {**AGENT, **own, **headers}, timeout, body)
    return (*reply[:5], "action not found") if STALE_ACTION in (reply[3] or "") else reply


def acted(df: DataFrame, router_tree: str = ROUTER_TREE, timeout: float = 15.0, headers: dict | None = None, cookies: dict | None = None, at_once: int = 8, transport=None) -> DataFrame:
    """Responses to server actions: rows of url, action_id, args (JSON array) and, if there are any, files (filename, data).

    The body of a response is a row stream, in ``html``.  An unknown action id is the error ``action not found``.
    """
    sent = _headers(headers, cookies)
    files = F.col("files") if "files" in df.columns else F.lit(None).cast(FILES)
    return _responses(df.select("url", "action_id", "args", files.alias("files")), RESPONSE, lambda o, u, action, args, files: act(o, u, action, args, files, router_tree, sent, timeout), at_once, transport)


def stream_requests(df: DataFrame, pattern: str | None = None, flag: str | None = None, url: str = "url", headers: str = "headers", config=None) -> DataFrame:
    """Requests with ``stream``, and for those the headers that ask for the row stream; headers that are there already stay.

    A request is eligible if its ``flag`` is true, or if that is null and its URL matches the pattern (``rsc_url_pattern`` of the settings).
    """
    pattern = config.rsc_url_pattern if config is not None else pattern
    like = F.col(url).rlike(pattern) if pattern else F.lit(False)
    eligible = F.coalesce(F.col(flag), like) if flag else like
    path = F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    own = F.create_map(F.lit("RSC"), F.lit("1"), F.lit("Next-Url"), F.coalesce(path, F.lit("/")))
    have = F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")) if headers in df.columns else F.create_map().cast("map<string,string>")
    named = F.transform(F.map_keys(have), lambda k: F.lower(k))
    more = F.map_filter(own, lambda k, v: ~F.array_contains(named, F.lower(k)))
    return df.withColumn("stream", F.coalesce(eligible, F.lit(False))).withColumn(headers, F.when(F.col("stream"), F.map_concat(have, more)).otherwise(have))


def action_meta(action_id: Column, router_tree: Column | None = None, **extra: Column) -> Column:
    """What a request's answer has to know of its action, as a map column."""
    own = {"action_id": action_id, "router_state_tree": F.lit(None) if router_tree is None else router_tree, **extra}
    return F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("string"))])


def read_action_meta(meta: Column) -> Column:
    """The map of ``action_meta``; an empty one for null."""
    return F.coalesce(meta, F.create_map().cast("map<string,string>"))


class PagesOverHttp(DataSource):
    """``spark.read.format("flight_http").option("urls", "a b").load()``; options: mode, timeout, partitions."""

    @classmethod
    def name(cls) -> str:
        return "flight_http"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.mode, self.timeout, self.parts = options.get("mode", "page"), float(options.get("timeout", 15)), int(options.get("partitions", 8))

    def partitions(self):
        n = max(1, min(self.parts, len(self.urls)))
        return [InputPartition(self.urls[i::n]) for i in range(n)]

    def read(self, partition):
        opener = urllib.request.build_opener()
        for url in partition.value:
            reply = get(opener, url, self.mode, self.timeout, {}, True)
            yield url, reply[3], reply[5]
