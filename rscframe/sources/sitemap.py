"""URLs of sites' sitemaps.  An index is followed level by level; a map that cannot be had or read gives none."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import web

DEEPEST = 3


def locations(text: str | None) -> tuple[bool, list[str]]:
    """Whether a document is an index, and what its ``loc`` elements hold."""
    try:
        top = ET.fromstring(text or "")
    except (ET.ParseError, ValueError):
        return False, []
    plain = [(e.tag.rpartition("}")[2], (e.text or "").strip()) for e in top.iter() if isinstance(e.tag, str)]
    return plain[0][0] == "sitemapindex", [t for tag, t in plain if tag == "loc" and t]


def address(site: Column) -> Column:
    """A sitemap's own address, or the usual one of a site."""
    bare = F.rtrim(site, F.lit("/"))
    return F.when(F.lower(bare).endswith(".xml"), site).otherwise(F.concat(bare, F.lit("/sitemap.xml")))


def parsed(replies: DataFrame) -> DataFrame:
    """site, is_index, loc: a row for each location of the maps (site, html)."""

    def run(batches):
        for b in batches:
            for site, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index, found = locations(text)
                yield pa.RecordBatch.from_arrays([pa.array([site] * len(found), pa.string()), pa.array([index] * len(found), pa.bool_()), pa.array(found, pa.string())], ["site", "is_index", "loc"])

    return replies.select("site", "html").mapInArrow(run, "site string, is_index boolean, loc string")


def discovered(sites: DataFrame, deepest: int = DEEPEST, timeout: float = 15.0, url: str = "url") -> DataFrame:
    """site, loc of every page that the sitemaps of the sites name, followed through at most ``deepest`` levels of indexes.

    Maps of a level are fetched once and checkpointed (in ``spark.checkpoint.dir``), so that a later level does not fetch them again.
    """
    spark = sites.sparkSession
    if not spark.sparkContext.getCheckpointDir() and (where := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(where)
    found, level = None, sites.select(F.col(url).alias("site"), address(F.col(url)).alias("url"))
    for depth in range(deepest + 1):
        replies = web.fetched(level.select("url").distinct(), timeout=timeout)
        here = parsed(level.join(replies, "url")).checkpoint()
        pages = here if depth == deepest else here.where("not is_index")
        found = pages.select("site", "loc") if found is None else found.unionByName(pages.select("site", "loc"))
        level = here.where("is_index").select("site", address(F.col("loc")).alias("url"))
        if depth < deepest and level.isEmpty():
            break
    return found
