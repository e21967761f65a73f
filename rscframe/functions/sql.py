"""Table functions and functions for SQL: ``SELECT p.page_id, r.* FROM pages p, LATERAL flight_rows(p.html) r``.

The functions exchange whole Arrow columns.  Table functions take a page a call, as a lateral join has it (Spark refuses Arrow tables there), and their
rows go back as Arrow data; ``operators.tables`` takes whole batches of pages.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import StringType

from rscframe.kernel.flight import Page, dumps, type_name, unwound

ROWS = "pos int, chunk_key string, chunk_id string, kind string, raw string, value_json string"
RESOLVED = "pos int, chunk_key string, kind string, value_type string, value_json string"
NODES = "ord int, parent_ord int, depth int, source string, key string, idx int, path array<string>, ntype string, first_visit boolean, value_json string, scalar_json string"


def rows_of(page: Page) -> list[tuple]:
    return [(pos, key, cid, kind, raw, dumps(page.values[key])) for key, (pos, cid, kind, raw) in page.rows.items()]


def resolved_of(page: Page) -> list[tuple]:
    return [(pos, key, kind, type_name(page.resolve(key)), page.text(key)) for key, (pos, _, kind, _) in page.rows.items()]


def nodes_of(page: Page) -> list[tuple]:
    out = []
    for at, parent, depth, source, key, idx, trail, v, first, _, _ in page.nodes():
        box = isinstance(v, (dict, list))
        out.append((at, parent, depth, source, None if key is None else str(key), idx, unwound(trail), type_name(v), first, dumps(v) if box and first else None, None if box else dumps(v)))
    return out


class FlightRows:
    def eval(self, html: str):
        yield from rows_of(Page(html))


class FlightResolved:
    def eval(self, html: str):
        yield from resolved_of(Page(html))


class FlightNodes:
    def eval(self, html: str):
        yield from nodes_of(Page(html))


TABLES = {"flight_rows": (FlightRows, ROWS), "flight_resolved": (FlightResolved, RESOLVED), "flight_nodes": (FlightNodes, NODES)}


@arrow_udf(StringType())
def joined(base: pa.Array, url: pa.Array) -> pa.Array:
    """Addresses as seen from a base; null for no address."""
    return pa.array([None if u is None else urljoin(b or "", u) for b, u in zip(base.to_pylist(), url.to_pylist())], pa.string())


def register(spark: SparkSession) -> None:
    from rscframe.functions.normalize import unescaped
    from rscframe.sources.web import PagesOverHttp

    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=schema, useArrow=True))
    spark.udf.register("flight_unescape", unescaped)
    spark.udf.register("flight_urljoin", joined)
    spark.dataSource.register(PagesOverHttp)
