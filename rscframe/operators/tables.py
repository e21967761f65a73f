"""Tables over pages: chunks, resolved values, nodes, matches and flat paths, each by one narrow pass.

Every function takes a DataFrame with ``page_id`` and ``html`` and yields rows for each page; nothing is shuffled.  What a
caller does not ask for is not built: ``columns`` names what is wanted of a table (Catalyst cannot prune behind the kernel), a test goes into the
kernel, a limit ends a page's walk.  Rows leave in batches bounded by number and by characters.

No page ends a job or loses rows in silence: a row nested too deeply for the JSON scanner has the status ``too_deep`` and its text as
value; a page of more than ``NODE_BUDGET`` nodes ends with a node marked ``cut``; a resolved value that may be longer than
``MOST_CHARS`` is null and marked ``too_long``.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rscframe.kernel import flight
from rscframe.kernel.flight import MISSING, Page, below, dumps, leaves, shape, type_name, unwound

ROWS_A_BATCH, CHARS_A_BATCH = 4096, 16_000_000


def page_rows(df: DataFrame, make: Callable[..., Iterator[tuple]], schema: str, strict: bool = False, html: str = "html", id: str = "page_id", beside: str | None = None, **options: Any) -> DataFrame:
    """Rows of ``make`` for each page (and its value of the column ``beside``), after its id; with ``strict`` a malformed row ends the job."""
    if strict and options.get("repair"):
        raise ValueError("strict and repair exclude each other")
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    full = f"{id} {kind}, {schema}"
    described = spark.createDataFrame([], full).schema.jsonValue()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        target = to_arrow_schema(StructType.fromJson(described))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        rows: list[tuple] = []
        gc.disable()  # pages make many objects and no circles; reference counts free them
        try:
            for b in batches:
                chars = 0
                for row in zip(*b.columns):  # one page at a time is a Python string
                    pid, text, *more = (x.as_py() for x in row)
                    chars += len(text or "")
                    for r in make(Page(text, strict=strict, **options), *more):
                        rows.append((pid, *r))
                        if len(rows) >= ROWS_A_BATCH:
                            yield batch(rows)
                            rows, chars = [], 0
                    if chars > CHARS_A_BATCH and rows:
                        yield batch(rows)
                        rows, chars = [], 0
            if rows:
                yield batch(rows)
        finally:
            gc.enable()

    return df.select(F.col(id), F.col(html), *([F.col(beside)] if beside else [])).mapInArrow(run, full)


def chosen(all_: dict[str, tuple[str, Callable]], columns: Iterable[str] | None) -> tuple[str, list[Callable]]:
    """Schema and functions of the wanted columns; all of them without a choice."""
    names = list(all_) if columns is None else list(columns)
    if unknown := set(names) - set(all_):
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    return ", ".join(f"{n} {all_[n][0]}" for n in names), [all_[n][1] for n in names]


#: name: (type, value of a page, a key, the key's row (pos, id, kind, raw) and its first pushes)
CHUNKS: dict[str, tuple[str, Callable]] = {
    "pos": ("int", lambda p, k, r, at: r[0]),
    "chunk_key": ("string", lambda p, k, r, at: k),
    "chunk_id": ("string", lambda p, k, r, at: r[1]),
    "kind": ("string", lambda p, k, r, at: r[2]),
    "raw": ("string", lambda p, k, r, at: r[3]),
    "value_type": ("string", lambda p, k, r, at: type_name(p.values[k])),
    "value_size": ("int", lambda p, k, r, at: len(v) if isinstance(v := p.values[k], (dict, list, str)) else 0),
    "status": ("string", lambda p, k, r, at: p.status[k]),
    "push_idx": ("int", lambda p, k, r, at: at.get(k, 0)),
    "is_html": ("boolean", lambda p, k, r, at: r[2] == "text" and flight.HTML_TAG.search(r[3]) is not None),
    "value_json": ("string", lambda p, k, r, at: dumps(p.values[k])),
}


def chunks(df: DataFrame, strict: bool = False, repair: bool = False, columns: Iterable[str] | None = None, **where: str) -> DataFrame:
    """One row a chunk with the wanted ``columns`` of CHUNKS (all: pos, chunk_key, ..., value_json, which is not resolved)."""
    schema, made = chosen(CHUNKS, columns)
    pushes = columns is None or "push_idx" in columns

    def make(p: Page):
        at = p.push_index() if pushes else {}
        for k, r in p.rows.items():
            yield [f(p, k, r, at) for f in made]

    return page_rows(df, make, schema, strict, repair=repair, **where)


#: What D7-D9 of the page API choose: chunks by the type of their value or their kind.
CHOICES: dict[str, Callable[[Page, str], bool]] = {
    "json": lambda p, k: isinstance(p.values[k], (dict, list)),
    "text": lambda p, k: p.rows[k][2] == "text",
    "html": lambda p, k: p.rows[k][2] == "text" and flight.HTML_TAG.search(p.rows[k][3]) is not None,
}


def resolved(df: DataFrame, decode_values: bool = True, repair: bool = False, which: str | None = None, keys: Iterable[str] | None = None, fresh: bool = False, **where: str) -> DataFrame:
    """One row a chunk with its resolved value as ordered JSON: pos, chunk_key, kind, value_type, value_json, too_long.

    ``which`` is json, html or text; ``keys`` names chunks.  Links in a circle are cut where they are met first, which depends on the order of
    chunks: that of the page, or with ``fresh`` each chunk by itself, as if it were asked for alone.
    """
    wanted, test = None if keys is None else set(keys), CHOICES[which] if which else None

    def make(p: Page):
        for key in p.keys():
            if fresh:
                p.forget()
            elif wanted is None and test is None:
                p.resolve(key)
            if (wanted is None or key in wanted) and (test is None or test(p, key)):
                v, (pos, _, kind, _) = p.resolve(key), p.rows[key]
                text = p.text(key)
                yield pos, key, kind, type_name(v), text, text is None

    return page_rows(df, make, "pos int, chunk_key string, kind string, value_type string, value_json string, too_long boolean", decode_values=decode_values, repair=repair, **where)


def keys_of(df: DataFrame, which: str | None = None, **where: str) -> DataFrame:
    """A row a page: the keys of its chunks in order, all or those that are json, html or text, and how many there are."""
    test = CHOICES[which] if which else None

    def make(p: Page):
        names = [k for k in p.rows if test is None or test(p, k)]
        yield names, len(names)

    return page_rows(df, make, "keys array<string>, n int", **where)


def with_chunk(df: DataFrame, key: str, **where: str) -> DataFrame:
    """A row a page: whether it has the chunk, its kind and its resolved value."""

    def make(p: Page):
        there = key in p
        yield there, p.rows[key][2] if there else None, dumps(p.resolve(key)) if there else None

    return page_rows(df, make, "has boolean, kind string, value_json string", **where)


def shapes(df: DataFrame, max_depth: int = 3, **where: str) -> DataFrame:
    def make(p: Page):
        for key, (pos, *_) in p.rows.items():
            yield pos, key, dumps(shape(p.resolve(key), max_depth))

    return page_rows(df, make, "pos int, chunk_key string, shape string", **where)


def _scalar(v: Any) -> str | None:
    return None if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v)


#: name: (type, value of a node (ord, parent, depth, source, key, index, trail, value, first visit, in a dict, cut))
NODES: dict[str, tuple[str, Callable]] = {
    "ord": ("int", lambda n: n[0]),
    "parent_ord": ("int", lambda n: n[1]),
    "depth": ("int", lambda n: n[2]),
    "source": ("string", lambda n: n[3]),
    "key": ("string", lambda n: None if n[4] is None else str(n[4])),
    "idx": ("int", lambda n: n[5]),
    "path": ("array<string>", lambda n: unwound(n[6])),
    "ntype": ("string", lambda n: type_name(n[7])),
    "keys": ("array<string>", lambda n: [str(k) for k in n[7]] if isinstance(n[7], dict) else None),
    "sval": ("string", lambda n: _scalar(n[7])),
    "first_visit": ("boolean", lambda n: n[8]),
    "in_dict": ("boolean", lambda n: n[9]),
    "cut": ("boolean", lambda n: n[10]),
}


def nodes(df: DataFrame, columns: Iterable[str] | None = None, budget: int | None = None, **where: str) -> DataFrame:
    """One row a node of the resolved page, in preorder, with the wanted columns of NODES.

    Shared objects are expanded wherever they are reached; ``first_visit`` tells the first of these places.
    """
    schema, made = chosen(NODES, columns)
    most = flight.NODE_BUDGET if budget is None else budget

    def make(p: Page):
        for n in p.nodes(most):
            yield [f(n) for f in made]

    return page_rows(df, make, schema, **where)


def matches(df: DataFrame, wanted: Callable[[Any], bool], limit: int | None = None, dedupe: bool = False, **where: str) -> DataFrame:
    """The containers that are wanted, each object once a page, in preorder: ord, source, path, keys, value_json.

    The test is made in the kernel, and a limit ends a page's walk: chunks that come later are not resolved.  With
    ``dedupe`` the first of equal ones (key order aside) of a page is left; their whole texts are compared.
    """

    def make(p: Page):
        found, known = 0, set()
        for at, source, trail, v in p.objects():
            if wanted(v):
                if dedupe:
                    same = dumps(v, True)
                    if same in known:
                        continue
                    known.add(same)
                yield at, source, unwound(trail), [str(k) for k in v] if isinstance(v, dict) else None, dumps(v)
                found += 1
                if found == limit:
                    return

    return page_rows(df, make, "ord int, source string, path array<string>, keys array<string>, value_json string", **where)


def strings(df: DataFrame, pattern: str, name: str, also: str | None = None, keys: Iterable[str] | None = None, in_dicts: bool = False, **where: str) -> DataFrame:
    """Distinct strings of a page that match the patterns, with their rank by first place: ord, ``name``."""
    named = None if keys is None else set(keys)

    def make(p: Page):
        import re

        one, two = re.compile(pattern).search, re.compile(also or "").search
        yield from enumerate(p.strings(lambda s: one(s) and two(s), named, in_dicts))

    return page_rows(df, make, f"ord int, {name} string", **where)


def projected(df: DataFrame, paths: list[str], sep: str = ".", **where: str) -> DataFrame:
    """A JSON column for each path (chunk key, then keys, indices and ``props``); null where there is none.

    Only the chunks that the paths name, and what they refer to, are resolved.
    """

    def make(p: Page):
        out = []
        for path in paths:
            chunk, *steps = path.split(sep)
            v = below(p.resolve(chunk), steps, MISSING) if chunk in p else MISSING
            out.append(None if v is MISSING else dumps(v))
        yield (out,)

    rows = page_rows(df, make, "vals array<string>", **where)
    return rows.select(where.get("id", "page_id"), *[F.col("vals")[i].alias(f"p{i}") for i in range(len(paths))])


def flat(df: DataFrame, id_key: str | None = None, **where: str) -> DataFrame:
    """One row a leaf: path, value_json, and value_key, which is equal where values are (1, 1.0 and true are); the last of equal paths."""

    def make(p: Page):
        for path, v in dict(leaves(p.resolve_all(), id_key)).items():
            yield path, dumps(v), equality_key(v)

    return page_rows(df, make, "path string, value_json string, value_key string", **where)


def equality_key(v: Any) -> str | None:
    """Equal for equal values; null for NaN, which equals nothing."""
    if isinstance(v, (bool, int, float)):
        if v != v:
            return None
        return f"n:{int(v)}" if abs(v) != float("inf") and v == int(v) else f"n:{v!r}"
    return f"{type_name(v)}:{dumps(v, True)}"
