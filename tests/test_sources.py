import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from rscframe.functions import sql
from rscframe.operators import search, tables
from rscframe.settings import CrawlConfig
from rscframe.sources import files, sitemap, web

ROWS = '0:{"a":1,"r":"$1"}\n1:{"b":"x@y.zz"}\n'
PAGE = f"<html><script>self.__next_f.push([1,{json.dumps(ROWS)}])</script><a href='/p?_rsc=b1'></a></html>"


class Site(BaseHTTPRequestHandler):
    def reply(self, text, code=200, **headers):
        body = gzip.compress(text.encode()) if headers.get("Content_Encoding") == "gzip" else text.encode()
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        here = f"http://127.0.0.1:{self.server.server_port}"
        path = self.path.split("?")[0]
        if self.headers.get("RSC"):
            self.reply(ROWS if "_rsc=b1" in self.path and self.headers["Next-Url"] == path else "none")
        elif path == "/sitemap.xml":
            self.reply(f'<sitemapindex xmlns="urn:s"><sitemap><loc>{here}/one.xml</loc></sitemap><sitemap><loc>{here}/bad.xml</loc></sitemap></sitemapindex>')
        elif path == "/one.xml":
            self.reply(f"<urlset><url><loc> {here}/p </loc></url><url><loc>{here}/q</loc></url></urlset>")
        elif path == "/bad.xml":
            self.reply("<urlset")
        elif path == "/cookie":
            self.reply(self.headers.get("Cookie", "none"), Set_Cookie="s=1; Path=/")
        elif path == "/draft":
            self.reply(self.headers.get("Cookie", "none"), Set_Cookie="__prerender_bypass=1; Path=/")
        elif path == "/gone":
            self.reply("gone", 404)
        else:
            self.reply(PAGE, Content_Encoding="gzip")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        known = self.headers["Next-Action"] == "good"
        self.reply(f"0:{json.dumps({'got': body, 'cookie': self.headers.get('Cookie'), 'tree': self.headers['Next-Router-State-Tree']})}\n" if known else "Failed to find Server Action", 200 if known else 404)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_and_errors(spark, site):
    urls = spark.createDataFrame([(f"{site}/p",), (f"{site}/gone",), ("http://127.0.0.1:1/",), ("file:///etc/hostname",)], "url string")
    got = {r.url: r for r in web.fetched(urls, timeout=5).collect()}
    assert got[f"{site}/p"].html == PAGE and got[f"{site}/p"].error is None and got[f"{site}/p"].status == 200
    assert got[f"{site}/gone"].error == "HTTP 404" and got[f"{site}/gone"].html == "gone"
    assert got["file:///etc/hostname"].html is None and got["file:///etc/hostname"].error
    assert got["http://127.0.0.1:1/"].status is None and got["http://127.0.0.1:1/"].error


def test_stream_mode_finds_the_build(spark, site):
    assert web.fetched(spark.createDataFrame([(f"{site}/p",)], "url string"), mode="stream").first().html == ROWS


def test_session_hands_on_cookies(spark, site):
    rows = spark.createDataFrame([(f"{site}/cookie", 1), (f"{site}/cookie?2", 2)], "url string, n int")
    assert {r.url: r.html for r in web.sessions(rows, "n").collect()} == {f"{site}/cookie": "none", f"{site}/cookie?2": "s=1"}


def test_actions(spark, site):
    rows = spark.createDataFrame([(site, "good", '["a",1]'), (site, "stale", "[]")], "url string, action_id string, args string")
    got = {r.error: r.html for r in web.acted(rows).collect()}
    assert json.loads(got[None][2:])["got"] == '["a", 1]' and "action not found" in got


def test_session_actions_use_cookies_and_router_trees(spark, site):
    rows = [(f"{site}/cookie", 1, None, None, None), (f"{site}/cookie", 2, "good", '["a"]', None), (f"{site}/cookie", 3, "good", "[]", '["own"]'), (f"{site}/cookie", 4, "good", "[]", None), (f"{site}/q", 5, "stale", "[]", None)]
    got = web.sessions(spark.createDataFrame(rows, "url string, n int, action_id string, args string, router_tree string"), "n").collect()
    answers = [json.loads(r.html[2:]) for r in got[1:4]]
    assert [a["cookie"] for a in answers] == ["s=1"] * 3 and answers[0]["got"] == '["a"]'
    assert [r.router_tree for r in got] == [web.ROUTER_TREE, web.ROUTER_TREE, '["own"]', '["own"]', web.ROUTER_TREE] and got[4].error == "action not found"


def test_sessions_drop_draft_cookies_and_are_apart(spark, site):
    rows = spark.createDataFrame([(f"{site}/draft?{n}", n, s) for n, s in ((1, "a"), (2, "a"), (3, "b"))] + [(f"{site}/cookie?4", 4, "a"), (f"{site}/cookie?5", 5, "b"), (f"{site}/cookie?6", 6, "b")], "url string, n int, s string")
    read = lambda **k: {r.url[-1]: r.html for r in web.sessions(rows, "n", session="s", **k).collect()}
    assert read() == {"1": "none", "2": "none", "3": "none", "4": "none", "5": "none", "6": "s=1"}
    assert read(config=CrawlConfig(strip_draft_cookies=False))["2"] == "__prerender_bypass=1"


class Canned:
    """A transport of the caller's own."""

    class Reply:
        status, headers = 200, __import__("email.message", fromlist=["Message"]).Message()
        read = staticmethod(lambda: b"canned")
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    def open(self, request, timeout):
        return self.Reply()


def test_transports_can_be_replaced(spark):
    assert web.fetched(spark.createDataFrame([("http://nowhere.example/",)], "url string"), transport=Canned).first().html == "canned"


def test_typed_extraction(spark):
    from dataclasses import dataclass, field
    from typing import Optional

    from rscframe.kernel.flight import FlightError  # noqa: F401

    @dataclass
    class Inner:
        x: int

    @dataclass
    class Model:
        a: int
        more: Optional[Inner] = None
        names: list[str] = field(default_factory=lambda: ["none"])

    df = spark.createDataFrame([(1, '0:{"a":1,"more":{"x":2,"y":3},"z":0}'), (2, '0:{"b":1}')], "page_id long, html string")
    assert [r.asDict(True) for r in search.extract_as(df, Model, keys=["a"]).collect()] == [{"page_id": 1, "a": 1, "more": {"x": 2}, "names": ["none"]}]
    assert search.extract_as(df, Model).count() == 0
    assert search.extract_as(df, Model, keys=["b"], on_missing="mark").first().missing == ["a"]
    with pytest.raises(Exception, match="no value for a"):
        search.extract_as(df, Model, keys=["b"]).collect()
    for bad in (dict, 3):
        with pytest.raises(TypeError):
            search.extract_as(df, bad)
    with pytest.raises(ValueError):
        search.records(df, "a long")


def test_deep_pages_lose_no_rows(spark):
    deep = "[" * 1500 + "]" * 1500
    page = f'0:{{"a":1}}\n1:{deep}\n2:{{"a":2}}'
    df = spark.createDataFrame([(1, page), (2, '0:{"a":3}')], "page_id long, html string")
    assert tables.resolved(df).count() == 4 and search.find_all_by_keys(df, ["a"]).count() == 3
    cut = tables.nodes(df, budget=3)
    assert sorted((r.page_id, r.cut) for r in cut.where("cut or page_id = 2").collect()) == [(1, True), (2, False), (2, False)]


def test_known_formats_can_be_given(spark, tmp_path):
    from rscframe.functions import pages as P

    (tmp_path / "own.json").write_text('{"range":"1","markers":["x"],"notes":"n"}\n{"range":"2","markers":["x","y"]}\n')
    known = P.known_versions(P.registry(spark, str(tmp_path / "own.json")))
    df = spark.createDataFrame([("x",), ("yx",), ("z",)], "html string")
    assert [r[0] for r in df.select(P.version_hint(df.html, known)).collect()] == ["1", "2", None]
    assert P.registry(spark).count() == 4


def test_action_files():
    body, kind = web.action_body(["t", 2], [{"filename": "f", "data": b"\x00z"}])
    assert kind.startswith("multipart/form-data; boundary=") and b'name="2"; filename="f"' in body and b"\x00z" in body and b'name="1"\r\n\r\n2\r\n' in body


def test_sitemaps(spark, site, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = sitemap.discovered(spark.createDataFrame([(site,), (f"{site}/nothing.xml",)], "url string"))
    assert sorted(r["loc"] for r in got.collect()) == [f"{site}/p", f"{site}/q"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    df = files.pages(spark, str(tmp_path / "*.html"))
    assert json.loads(files.page_objects(df).first().value) == {"0": {"a": 1, "r": {"b": "x@y.zz"}}, "1": {"b": "x@y.zz"}}
    hits = search.find_any_keys(df, ["a", "b"])
    files.write_csv(hits, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b", "r"] and sorted((r.a or "", r.b or "", r.r or "") for r in back.collect()) == [("", "x@y.zz", ""), ("1", "", '{"b":"x@y.zz"}')]
    files.write_csv(search.find_any_keys(df, ["none"]), str(tmp_path / "none"))


def test_sql_functions(spark, site):
    sql.register(spark)
    spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string").createOrReplaceTempView("flight_pages")
    assert [tuple(r) for r in spark.sql("SELECT page_id, r.chunk_key, r.kind FROM flight_pages p, LATERAL flight_rows(p.html) r ORDER BY 2").collect()] == [(1, "0", "json"), (1, "1", "json")]
    assert spark.sql("SELECT count(*) FROM flight_pages p, LATERAL flight_nodes(p.html) n WHERE n.ntype = 'str'").first()[0] == 2
    assert spark.sql("SELECT flight_urljoin('http://a/b/', '../c')").first()[0] == "http://a/c"
    assert spark.read.format("flight_http").option("urls", f"{site}/p {site}/gone").load().count() == 2


def test_command_line(spark, tmp_path, capsys):
    from rscframe.__main__ import main

    (tmp_path / "a.html").write_text(PAGE)
    source = str(tmp_path / "a.html")
    for flags, want in ((["--keys", "b"], {"b": "x@y.zz"}), (["--get", "0.r.b", "--redact"], "[REDACTED_EMAIL]"), (["--router"], "app"), (["--json-keys"], ["0", "1"]), (["--text", "@"], ["x@y.zz"]), (["--all"], {"0": {"a": 1, "r": {"b": "x@y.zz"}}, "1": {"b": "x@y.zz"}}), (["--any-keys", "a,b"], [{"a": 1, "r": {"b": "x@y.zz"}}, {"b": "x@y.zz"}]), (["--keys", "none"], None), (["--all-by-keys", "none"], []),
                        (["--type", "x@y.zz", "--type-key", "b"], [{"b": "x@y.zz"}]), (["--pagination"], None), (["--tree"], {"0": {"a": "int", "r": {"b": "str"}}, "1": {"b": "str"}}), (["--html-keys"], []),
                        (["--stats"], {"chunk_count": 2, "chunk_ids": ["0", "1"], "value_type_counts": {"dict": 2}, "flight_row_kind_counts": {"json": 2}})):
        assert main([source, *flags]) == 0 and json.loads(capsys.readouterr().out) == want
    assert main([source, "--next-data"]) == 1
    with pytest.raises(SystemExit):
        main([source])


def test_settings():
    assert CrawlConfig.of({"THROTTLE_WINDOW": 3, "dedupe_keys": ["a"]}).dedupe_keys == ("a",) and CrawlConfig.recommended(strict=False).repair
    assert CrawlConfig.of({"dedupe_key": "a"}).dedupe_keys == ("a",) and CrawlConfig(repair=True).parsing == {"strict": False, "repair": True}
    for bad in ({"strict": True, "repair": True}, {"nothing": 1}, {"dedupe_key": "a", "dedupe_keys": ["b"]}):
        with pytest.raises(ValueError):
            CrawlConfig.of(bad)
