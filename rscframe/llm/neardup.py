"""MinHash near-duplicates by tensored banding, confirmed on full sets of three-word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case.  A document's set has its
distinct shingles; a text with fewer words is one shingle; a text without words (or null) has an
empty set and is linked with nothing.  Documents with 100 * intersection >= 85 * union are linked;
a component is named by the least doc_id that can be reached.  ``linking`` has the method, and what
becomes of null and repeated ids.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import linking
from .textkit import table

PLAN = linking.Plan(size=3, percent=85)
#: What a stage of the pipeline takes: five-word shingles and a similarity of 0.8.
STAGE_PLAN = linking.Plan(size=5, percent=80, collections=18)


def near_duplicates(df: DataFrame, plan: linking.Plan = PLAN, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return linking.components(df, plan, text=text, id=id).drop("set_id")


def without_near_duplicates(df: DataFrame, plan: linking.Plan = STAGE_PLAN) -> DataFrame:
    """The rows of df but those of documents whose component has another, kept document."""
    gone = near_duplicates(df, plan).where("not kept").select("doc_id").distinct()
    return df.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
SQL = {
    "op4_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
c AS (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS k, min(doc_id) AS rep, any_value(sh) AS sh, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
r AS (SELECT rep, n, unnest(list_sort(sh)) AS t, unnest(range(1, n + 1)) AS pos FROM c),
p AS (SELECT rep, n, t FROM r WHERE pos <= n - ceil(0.85 * n) + 1),
cand AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM cand JOIN c a ON a.rep = x JOIN c b ON b.rep = y
  WHERE 100 * len(list_intersect(a.sh, b.sh)) >= 85 * (a.n + b.n - len(list_intersect(a.sh, b.sh)))),
e AS (SELECT x AS u, y AS v FROM link UNION ALL SELECT y, x FROM link),
reach(u, v) AS (SELECT rep, rep FROM c UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
comp AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.m, s.doc_id) AS component_id, s.doc_id = coalesce(comp.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.k = md5(array_to_string(list_sort(s.sh), chr(10))) AND len(s.sh) > 0 LEFT JOIN comp ON comp.u = c.rep
"""
}
