"""Schema-free search over pages, records of matches, diff and dedupe.

Searches are one narrow pass each: their tests are made in the kernel, and so are limits and what is distinct within a page.
"""

from __future__ import annotations

import dataclasses
import difflib
import re
import types
import typing
from collections.abc import Iterable
from datetime import date, datetime
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from rscframe.kernel.flight import FlightError, dumps

from . import tables

# Key sets of pagination objects, in order of preference; and what counts as a URL.
PAGINATION_KEYS = [["hasNextPage", "endCursor"], ["hasNextPage", "cursor"], ["hasNextPage", "nextCursor"], ["nextCursor"], ["endCursor"]]
URL_LIKE = r"^(?:https?://\S+|/[^\s\"'<>]+)$"
SLOT_KEY = r"^@[A-Za-z0-9_-]+$"
INTERCEPTING = r"^\((?:\.{1,3}|\.\.\)\(\.\.)\)$"


def has_all(keys: Iterable[str]):
    need = set(keys)
    return lambda v: isinstance(v, dict) and need <= v.keys()


def has_any(keys: Iterable[str]):
    some = set(keys)
    return lambda v: isinstance(v, dict) and not some.isdisjoint(v)


def has_key_like(pattern: str):
    test = re.compile(pattern).search
    return lambda v: isinstance(v, dict) and any(isinstance(k, str) and test(k) for k in v)


def has_value(key: str, value):
    return lambda v: isinstance(v, dict) and key in v and v[key] == value


def find_all(df: DataFrame, predicate, max_results: int | None = None, **where: str) -> DataFrame:
    """Containers for which a Python predicate holds, each object once a page, in document order."""
    return tables.matches(df, predicate, max_results, **where)


def find_one(df: DataFrame, predicate, **where: str) -> DataFrame:
    return find_all(df, predicate, 1, **where)


def find_all_by_keys(df: DataFrame, keys: Iterable[str], dedupe: bool = False, limit: int | None = None, **where: str) -> DataFrame:
    """Objects that have all keys; with ``dedupe`` equal ones (key order aside) once a page."""
    return tables.matches(df, has_all(keys), limit, dedupe, **where)


def find_by_keys(df: DataFrame, keys: Iterable[str], **where: str) -> DataFrame:
    return find_all_by_keys(df, keys, limit=1, **where)


def find_any_keys(df: DataFrame, keys: Iterable[str], **where: str) -> DataFrame:
    return tables.matches(df, has_any(keys), **where)


def find_by_key_pattern(df: DataFrame, pattern: str, **where: str) -> DataFrame:
    return tables.matches(df, has_key_like(pattern), **where)


def find_by_type(df: DataFrame, value, key: str = "@type", **where: str) -> DataFrame:
    return tables.matches(df, has_value(key, value), **where)


def pipeline_matches(df: DataFrame, config, **where: str) -> DataFrame:
    """What a crawl's settings ask for of each page (``pipeline_keys``, ``dedupe``, ``repair``, ``strict``); nothing without keys."""
    rows = df if config.pipeline_keys else df.where("false")
    return find_all_by_keys(rows, config.pipeline_keys, dedupe=config.dedupe, strict=config.strict, repair=config.repair, **where)


def find_urls(df: DataFrame, keys: Iterable[str] | None = None, pattern: str | None = None, **where: str) -> DataFrame:
    """Distinct entries of objects that look like URLs and match ``pattern``, under one of ``keys``; a chunk counts as an entry under its key."""
    return tables.strings(df, URL_LIKE, "url", also=pattern, keys=keys, in_dicts=True, **where)


def follow_urls(df: DataFrame, keys: Iterable[str] | None = None, pattern: str | None = None, base: str = "url", **where: str) -> DataFrame:
    """Requests for the URLs that pages name, joined to each page's own address: ord, link, target."""
    named = None if keys is None else set(keys)

    def make(p, address):
        test, also = re.compile(URL_LIKE).search, re.compile(pattern or "").search
        for at, s in enumerate(p.strings(lambda s: test(s) and also(s), named, True)):
            yield at, s, urljoin(address or "", s)

    return tables.page_rows(df, make, "ord int, link string, target string", beside=base, **where)


def find_text(df: DataFrame, pattern: str, **where: str) -> DataFrame:
    """Distinct strings anywhere that match a pattern, by first place."""
    return tables.strings(df, pattern, "text", **where)


def similar_keys(df: DataFrame, keys: str | Iterable[str], cutoff: float = 0.6, most: int = 5, **where: str) -> DataFrame:
    """For each page and wanted key the keys (chunk keys included) most like it: wanted, rank, key."""
    names = [keys] if isinstance(keys, str) else list(keys)

    def make(p):
        known = sorted(k for k in p.key_names() if isinstance(k, str))
        for name in names:
            for rank, k in enumerate(difflib.get_close_matches(name, known, n=most, cutoff=cutoff)):
                yield name, rank, k

    return tables.page_rows(df, make, "wanted string, rank int, key string", **where)


def pagination_of(page) -> tuple | None:
    """(preference, ord, source, keys, object) of a page's first object of the most preferred pagination key set."""
    tests, best = [has_all(ks) for ks in PAGINATION_KEYS], None
    for at, source, _, v in page.objects():
        for n, test in enumerate(tests[: best[0] if best else None]):
            if test(v):
                best = n, at, source, [str(k) for k in v], v
                break
        if best and best[0] == 0:
            break
    return best


def find_pagination(df: DataFrame, **where: str) -> DataFrame:
    """For each page the first object of the most preferred pagination key set."""

    def make(p):
        if found := pagination_of(p):
            yield *found[:4], dumps(found[4])

    return tables.page_rows(df, make, "preference int, ord int, source string, keys array<string>, value_json string", **where)


def is_slot_key(key: Column) -> Column:
    return key.rlike(SLOT_KEY)


def is_intercepting_segment(segment: Column) -> Column:
    return segment.rlike(INTERCEPTING)


# records ----------------------------------------------------------------------------------------


def as_records(found: DataFrame, schema: str | StructType, *keep: str) -> DataFrame:
    """Matches as typed columns."""
    return found.select(*keep, F.from_json("value_json", schema).alias("_r")).select(*keep, "_r.*")


def records(df: DataFrame, schema: str | StructType, keys: Iterable[str] | None = None, found: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records of given matches, or of the objects of the pages that have all keys."""
    if found is None and keys is None:
        raise ValueError("records need either matches or keys to find them by")
    return as_records(find_all_by_keys(df, keys) if found is None else found, schema, *keep)


_PLAIN = {str: "string", int: "bigint", float: "double", bool: "boolean", datetime: "timestamp", date: "date", typing.Any: "string", type(None): "string"}


def type_text(t) -> str:
    """The Spark type of a field's annotation; what is not known is kept as text."""
    if dataclasses.is_dataclass(t):
        return f"struct<{', '.join(f'`{n}`: {type_text(k)}' for n, k in model_fields(t).items())}>"
    origin, args = typing.get_origin(t), typing.get_args(t)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        return type_text(rest[0]) if len(rest) == 1 else "string"
    if origin in (list, set, tuple, frozenset):
        return f"array<{type_text(args[0]) if args else 'string'}>"
    if origin is dict:
        return f"map<string, {type_text(args[1]) if len(args) > 1 else 'string'}>"
    return {list: "array<string>", dict: "map<string, string>"}.get(t) or _PLAIN.get(t, "string")


def model_fields(model: type) -> dict[str, typing.Any]:
    hints = typing.get_type_hints(model)
    return {f.name: hints[f.name] for f in dataclasses.fields(model)}


def extract_as(df: DataFrame, model: type, keys: Iterable[str] | None = None, on_missing: str = "fail", **where: str) -> DataFrame:
    """For each page the first object with the keys (those of the model's fields unless given), as the typed columns of a dataclass.

    Other entries are left out.  A missing field has its default; one without a default ends the job, or with ``on_missing``
    "mark" is null and named in the column ``missing``.  A page without such an object has no row.
    """
    if not (isinstance(model, type) and dataclasses.is_dataclass(model)):
        raise TypeError(f"{model!r} is no dataclass")
    if on_missing not in ("fail", "mark"):
        raise ValueError("on_missing is fail or mark")
    fields = dataclasses.fields(model)
    none = dataclasses.MISSING
    defaults = {f.name: f.default if f.default is not none else f.default_factory() for f in fields if f.default is not none or f.default_factory is not none}
    names = [f.name for f in fields]
    test = has_all(names if keys is None else keys)

    def make(p):
        for _, _, _, v in p.objects():
            if test(v):
                missing = [n for n in names if n not in v and n not in defaults]
                if missing and on_missing == "fail":
                    raise FlightError(f"no value for {', '.join(missing)}")
                yield dumps({n: v[n] if n in v else defaults.get(n) for n in names}), missing
                return

    rows = tables.page_rows(df, make, "value_json string, missing array<string>", **where)
    schema = ", ".join(f"`{n}` {type_text(t)}" for n, t in model_fields(model).items())
    id = where.get("id", "page_id")
    got = rows.select(id, F.from_json("value_json", schema).alias("_r"), "missing").select(id, "_r.*", "missing")
    return got if on_missing == "mark" else got.drop("missing")


# diff and dedupe --------------------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame, id_key: str | None = None, on: str = "page_id") -> DataFrame:
    """added, removed and changed paths between two crawls: one full outer join on page and path."""
    a = tables.flat(old, id_key, id=on).select(on, "path", F.col("value_json").alias("old_value"), F.col("value_key").alias("_a"), F.lit(True).alias("_old"))
    b = tables.flat(new, id_key, id=on).select(on, "path", F.col("value_json").alias("new_value"), F.col("value_key").alias("_b"), F.lit(True).alias("_new"))
    both = a.join(b, [on, "path"], "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).where("change is not null").select(on, "path", "change", "old_value", "new_value")


def item_identity(item: Column, keys: Iterable[str] | None = None) -> Column:
    """What makes an item equal to another: its value or that of its keys; null for what is no object."""
    v = F.try_parse_json(item)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    same = F.to_json(F.struct(*[F.to_json(F.try_variant_get(v, f"$.{k}", "variant")).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.to_json(v)
    return F.when(is_object, same)


def crawl_deduped(items: DataFrame, order: str, keys: list[str] | None = None, item: str = "item_json") -> DataFrame:
    """Items whose value (or key values) did not occur before in a crawl; what is no object passes.

    The first arrival of each value is found by an aggregate that combines before the shuffle; a value that a third of all items
    share is so a row a task, not a sorted group.
    """
    named = items.withColumn("_same", item_identity(F.col(item), keys))
    others = named.where("_same is null").drop("_same")
    first = named.where("_same is not null").groupBy("_same").agg(F.min_by(F.struct(*items.columns), order).alias("_first")).select("_first.*")
    return first.unionByName(others)
