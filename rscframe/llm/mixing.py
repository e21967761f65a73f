"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, lang, source).  A budget of tokens is divided at the root among domains, in a domain among its languages, in
a language among its sources, each time by weight.  A node cannot take more than its supply times
``max_epochs``; what a child cannot take goes to its siblings by weight, and only what a whole family cannot take is
left to the families beside it (a node's limit is the sum of its children's).  The division is exact: whole
numbers, remainders to the largest fractions, ties by name.

A leaf's budget is filled by epochs: whole ones, then a prefix of the next.  In epoch e of a seed,
rows are ordered by md5("seed:e:doc_id"); the prefix has the rows that start before the leaf's
remainder is used up.  The cut is found by sums over 4,096 ranges of the digest in each leaf, then
in the one range that holds it, so no leaf is ever sorted as a whole.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Defined results: null texts have no tokens; a null domain, lang or source is a
leaf value of its own, ''; rows with one doc_id are taken together (equal digest); a leaf of weight
0 or without tokens gets nothing, but rows without tokens in a filled leaf are taken like others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .textkit import Workspace, table, unused

LEVELS = ["domain", "lang", "source"]
MOST_LEAVES = 10_000  # up to so many leaves (rows of ten small columns) the table of leaves is broadcast
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights``: for each level the weight of a name (whole numbers; others have 1)."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)  # the budget as a share of all tokens
    max_epochs: int = 4
    seed: int = 17

    def weight(self, level: str) -> Column:
        known = [F.lit(x) for name, w in sorted(self.weights.get(level, {}).items()) for x in (name, w)]
        return (F.coalesce(F.create_map(*known)[F.col(level)], F.lit(1)) if known else F.lit(1)).cast("long")


MIX = Mix({"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}})
DOMAIN = "case when right(source, 1) in ('0', '1', '2', '3') then 'web' when right(source, 1) in ('4', '5', '6') then 'books' else 'code' end"


def divided(nodes: DataFrame, parents: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Adds ``out``: the share of the parent's ``budget`` that falls to each node (columns cap, w)."""
    family = Window.partitionBy(*parents)
    rising = family.orderBy(F.col("cap") / F.col("w"), name)
    big = "decimal(38,0)"
    rows = nodes.withColumn("_before", F.sum("cap").over(rising) - F.col("cap")).withColumn("_weights", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    left = (F.col(budget) - F.col("_before")).cast(big)
    rows = rows.withColumn("_open", left * F.col("w") <= F.col("cap").cast(big) * F.col("_weights"))
    rows = rows.withColumn("_num", F.max(F.when(F.col("_open"), F.col(budget) - F.col("_before"))).over(family)).withColumn("_den", F.max(F.when(F.col("_open"), F.col("_weights"))).over(family))
    exact = F.col("_num").cast(big) * F.col("w")
    rows = rows.withColumn("_low", F.when(F.col("_open"), F.floor(exact / F.col("_den"))).otherwise(F.col("cap")).cast("long"))
    # decimal division is rounded; put it right where it went over or under
    over = (F.col("_low").cast(big) * F.col("_den") > exact) & F.col("_open")
    rows = rows.withColumn("_low", F.when(over, F.col("_low") - 1).otherwise(F.col("_low")))
    rows = rows.withColumn("_rest", F.when(F.col("_open"), exact - F.col("_low").cast(big) * F.col("_den")).otherwise(F.lit(-1).cast(big)))
    rows = rows.withColumn("_spare", F.col("_num") - F.sum(F.when(F.col("_open"), F.col("_low")).otherwise(0)).over(family))
    rows = rows.withColumn("_place", F.row_number().over(family.orderBy(F.col("_rest").desc(), name)))
    more = F.when(F.col("_open") & (F.col("_place") <= F.col("_spare")), 1).otherwise(0)
    return rows.withColumn(out, (F.col("_low") + more).cast("long")).drop("_before", "_weights", "_open", "_num", "_den", "_low", "_rest", "_spare", "_place")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """LEVELS, supply, budget of every leaf; leaves: LEVELS, supply."""
    rows = leaves.where("supply > 0")
    for level in LEVELS:
        rows = rows.withColumn(f"w_{level}", mix.weight(level))
    rows = rows.where(" and ".join(f"w_{x} > 0" for x in LEVELS)).withColumn("cap", F.col("supply") * mix.max_epochs)
    langs = rows.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w"))
    domains = rows.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w"))
    num, den = mix.share
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("tokens"))
    most = domains.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("most"))
    root = total.crossJoin(most).select(F.least(F.floor(F.col("tokens") * num / den).cast("long"), F.col("most")).alias("b0"))  # one row by one row
    domains = divided(domains.crossJoin(F.broadcast(root)).withColumn("_all", F.lit(0)), ["_all"], "domain", "b0", "b1").select("domain", "b1")
    langs = divided(langs.join(domains, "domain"), ["domain"], "lang", "b1", "b2").select("domain", "lang", "b2")
    own = rows.withColumn("w", F.col("w_source")).join(langs, ["domain", "lang"])
    return divided(own, ["domain", "lang"], "source", "b2", "budget").select(*LEVELS, "supply", "budget")


def with_leaves(df: DataFrame, domain: str = DOMAIN, names: list[str] = LEVELS) -> DataFrame:
    """df with the names of its leaf in the columns ``names``, which df must not have."""
    leaf = [F.expr(domain).cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")]
    return df.withColumns({n: F.coalesce(c, F.lit("")) for n, c in zip(names, leaf)})


def digest(mix: Mix, epoch: Column, id: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"))


def plan(df: DataFrame, mix: Mix, work: Workspace, domain: str = DOMAIN) -> tuple[DataFrame, DataFrame]:
    """(slim rows with doc_id, LEVELS, n_tokens; leaves with LEVELS, supply, budget, full, cut)."""
    names = unused(df, *(f"_{x}" for x in LEVELS))
    slim = with_leaves(df, domain, names).select("doc_id", *[F.col(n).alias(x) for n, x in zip(names, LEVELS)], F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    slim = work.cut(slim)
    budgets = leaf_budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), mix)
    budgets = work.cut(budgets.withColumn("full", F.expr("budget div supply")).withColumn("rest", F.expr("budget % supply")))
    keyed = slim.join(bounded(budgets), LEVELS).where("rest > 0").withColumn("key", digest(mix, F.col("full"))).withColumn("range", F.substring("key", 1, 3))
    ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    up_to = Window.partitionBy(*LEVELS).orderBy("range")
    held = ranges.withColumn("before", F.sum("n").over(up_to) - F.col("n")).where("before < rest").groupBy(*LEVELS).agg(F.max_by(F.struct("range", "before"), "range").alias("x")).select(*LEVELS, F.col("x.range").alias("range"), F.col("x.before").alias("before"))
    inside = keyed.join(held, [*LEVELS, "range"])
    w = Window.partitionBy(*LEVELS, "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*LEVELS, "range", "key")
    inside = inside.withColumn("start", F.col("before") + F.sum("n_tokens").over(w) - F.sum("n_tokens").over(same))
    cuts = inside.where("start < rest").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return slim, work.cut(budgets.join(cuts, LEVELS, "left").select(*LEVELS, "supply", "budget", "full", "rest", "cut"))


def bounded(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES else leaves


def epochs(mix: Mix, full: str = "full", cut: str = "cut") -> Column:
    """The epochs in which a row (with these columns of its leaf) is taken."""
    whole = F.when(F.col(full) > 0, F.sequence(F.lit(0).cast("long"), F.col(full) - 1)).otherwise(F.array().cast("array<bigint>"))
    part = F.when(digest(mix, F.col(full)) <= F.col(cut), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(whole, part)


def mixed(df: DataFrame, mix: Mix = MIX, domain: str = DOMAIN) -> DataFrame:
    """The rows of df, each as often as epochs take it, all columns unchanged, whatever their names."""
    _, leaves = plan(df, mix, Workspace(df.sparkSession), domain)
    *names, full, cut, epoch = unused(df, *(f"_{x}" for x in LEVELS), "_full", "_cut", "_epoch")
    leaves = leaves.select(*[F.col(x).alias(n) for x, n in zip(LEVELS, names)], F.col("full").alias(full), F.col("cut").alias(cut))
    rows = with_leaves(df, domain, names).join(bounded(leaves), names)
    return rows.withColumn(epoch, F.explode(epochs(mix, full, cut))).select(*[F.col(f"`{c}`") for c in df.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    slim, leaves = plan(table(spark, sf_dir, "documents"), MIX, Workspace(spark))
    rows = slim.join(bounded(leaves.select(*LEVELS, "full", "cut", "budget")), LEVELS)
    return rows.select("doc_id", *LEVELS, "n_tokens", F.explode(epochs(MIX)).alias("epoch"), "budget")


def _level_sql(table_: str, parents: str, name: str, budget: str, out: str) -> str:
    part = f"PARTITION BY {parents}"
    return f"""(SELECT *, CASE WHEN open THEN low + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, {name}) <= num - sum(CASE WHEN open THEN low ELSE 0 END) OVER ({part}) THEN 1 ELSE 0 END ELSE cap END AS {out} FROM
 (SELECT *, CASE WHEN open THEN num * w // den ELSE cap END AS low, CASE WHEN open THEN num * w % den ELSE -1 END AS rest FROM
 (SELECT *, max(CASE WHEN open THEN {budget} - before END) OVER ({part}) AS num, max(CASE WHEN open THEN ws END) OVER ({part}) AS den FROM
 (SELECT *, ({budget} - before) * w <= cap * ws AS open FROM
 (SELECT *, sum(cap) OVER ({part} ORDER BY cap / w, {name}) - cap AS before, sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {table_})))))"""


QUERIES = {"op2_mixing": op2_mixing}
SQL = {
    "op2_mixing": f"""
WITH d AS (SELECT doc_id, coalesce({DOMAIN}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * 4 AS cap, CASE source WHEN 'src0' THEN 3 ELSE 1 END AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
lg AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain, lang),
dm AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS w, 0 AS a FROM leaf GROUP BY domain),
dm0 AS (SELECT *, least((SELECT sum(supply) // 2 FROM leaf), (SELECT sum(cap) FROM leaf)) AS b0 FROM dm),
dm1 AS (SELECT domain, b1 FROM {_level_sql('dm0', 'a', 'domain', 'b0', 'b1')}),
lg0 AS (SELECT lg.*, b1 FROM lg JOIN dm1 USING (domain)),
lg1 AS (SELECT domain, lang, b2 FROM {_level_sql('lg0', 'domain', 'lang', 'b1', 'b2')}),
lf0 AS (SELECT leaf.*, b2 FROM leaf JOIN lg1 USING (domain, lang)),
lf AS (SELECT domain, lang, source, supply, CAST(budget AS BIGINT) AS budget, CAST(budget // supply AS BIGINT) AS full_, budget % supply AS rest FROM {_level_sql('lf0', 'domain, lang', 'source', 'b2', 'budget')}),
k AS (SELECT d.*, budget, full_, rest, md5(concat('17:', full_, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM d JOIN lf USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS start FROM k)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, unnest(CASE WHEN start < rest THEN range(0, full_ + 1) ELSE range(0, full_) END) AS epoch, budget FROM p
"""
}
