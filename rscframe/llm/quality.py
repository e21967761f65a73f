"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics`` reads each whole text once and gives the columns STATS.
2. On the driver, boosted shallow trees are grown on at most LEARN_ROWS labelled rows (the bound of
   the sample); each path from a root to a node is a conjunction of comparisons, a rule.
3. A logistic model with an L1 penalty (lasso, by accelerated proximal gradient) gives most
   rules the weight zero.
4. The rest become one Spark column expression, so that scoring is part of the plan.

Defined results: a null text counts as empty; empty texts are scored like others; without labelled
rows of both classes the score is the share of label 1 (0.5 if there is none).  Rows are
never merged; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textkit import _WHITE, arrow_map, frugal, held_out, labelled, segments, sigmoid, string_buffers, table, unused, word_hashes

STATS = ["chars", "words", "word_len", "upper", "digit", "punct", "symbol", "other", "newline", "distinct", "repeat", "common", "bang", "bar", "tail", "line_len"]
LEARN_ROWS, TREES, DEPTH, RATE, PENALTY = 20_000, 30, 3, 0.3, 1e-3
LEAST = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 lower case, 1 upper, 2 digit, 3 full stop or comma, 4 other punctuation, 5 white, 6 above ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 6 if _b > 127 else 1 if "A" <= _c <= "Z" else 0 if "a" <= _c <= "z" else 2 if _c.isdigit() else 3 if _c in ".,;:?'\"()-" else 5 if _WHITE[_b] else 4


def statistics_of(column: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    data, offs = string_buffers(column)
    out = np.zeros((len(offs) - 1, len(STATS)))
    for a, b in segments(data, offs):
        part, bounds = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        words, at = word_hashes(part, bounds, lower=False)
        classes = _CLASS[part]
        # a word that ends in a mark other than a full stop or comma
        ends = np.zeros(len(part), bool)
        if len(part):
            ends[:-1] = (classes[:-1] == 4) & (classes[1:] == 5)
        ended = np.concatenate([[0], np.cumsum(ends)])
        for r in range(b - a):
            lo, hi = bounds[r], bounds[r + 1]
            if hi == lo:
                continue
            n = hi - lo
            k = np.bincount(classes[lo:hi], minlength=7)
            raw = np.bincount(part[lo:hi], minlength=128)
            w = words[at[r] : at[r + 1]]
            m = max(len(w), 1)
            _, counts = np.unique(w, return_counts=True)
            solid = max(n - k[5], 1)
            same = (w[1:] == w[:-1]).sum() if len(w) > 1 else 0
            out[a + r] = (n, len(w), solid / m, k[1] / solid, k[2] / solid, k[3] / m, k[4] / m, k[6] / solid, raw[10] / m, len(counts) / m, same / m, (counts.max() if len(counts) else 0) / m, raw[33] / m, raw[124] / m, (ended[hi] - ended[lo]) / m, n / (raw[10] + 1))
    return out


def statistics(df: DataFrame, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and STATS of every row."""

    def run(batches):
        for b in batches:
            x = statistics_of(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, x.T)], [*b.schema.names[:-1], *STATS])

    rows = df.select(F.col(id).alias("doc_id"), *keep, F.col(text).cast("string").alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return arrow_map(rows, run, ", ".join([*kinds, *(f"{s} double" for s in STATS)]))


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, above, threshold), their weights, and the intercept."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, prefix: str = "") -> Column:
        """The probability of label 1 as a Spark expression over STATS."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for s, above, at in rule:
                c = F.col(prefix + STATS[s])
                cond = cond & (c > at if above else c <= at)
            total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + rule_matrix(x, self.rules) @ np.array(self.weights)) if self.rules else np.full(len(x), sigmoid(self.intercept))


def rule_matrix(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for s, above, at in rule:
            out[:, j] *= x[:, s] > at if above else x[:, s] <= at
    return out


def grow(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """A regression tree on the gradient: its paths as rules, and its fitted values."""
    rules, fitted = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        g = gradient[rows]
        fitted[rows] = g.mean()
        if path:
            rules.append(path)
        if left == 0 or len(rows) < 2 * least:
            return
        best = (1e-9, None)
        for s, c in enumerate(cuts):
            if not len(c):
                continue
            bins = np.searchsorted(c, x[rows, s], side="left")  # bin b: values <= c[b]
            n = np.cumsum(np.bincount(bins, minlength=len(c) + 1))[:-1]
            t = np.cumsum(np.bincount(bins, weights=g, minlength=len(c) + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            gain = np.where(ok, t**2 / np.maximum(n, 1) + (g.sum() - t) ** 2 / np.maximum(len(rows) - n, 1) - g.sum() ** 2 / len(rows), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (s, float(c[k])))
        if best[1]:
            s, at = best[1]
            low = x[rows, s] <= at
            split(rows[low], (*path, (s, False, at)), left - 1)
            split(rows[~low], (*path, (s, True, at)), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules, fitted


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, the intercept free, by FISTA."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    v = np.ones(z1.shape[1])
    for _ in range(20):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(z) / max(float(v @ (z1.T @ (z1 @ v))), 1e-9) * 0.98
    w = np.zeros(z1.shape[1])
    u, t = w, 1.0
    for _ in range(steps):
        new = u - step * (z1.T @ (sigmoid(z1 @ u) - y)) / len(z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 5) -> Rules:
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (y.sum() + 0.5) / (len(y) + 1)
        return Rules((), (), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))) for c in x.T]
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        own = np.sort(rng.permutation(len(y))[: max(len(y) // 2, 20)])
        p = sigmoid(margin)
        got, fitted = grow(x[own], (y - p)[own] * 4, cuts, depth, max(5, len(own) // 400))
        rules |= dict.fromkeys(got)
        part = rule_leaves(x, got)
        # the value of a leaf, from the sample it was grown on
        values = rule_leaves_values(part[own], fitted)
        margin = margin + RATE * values[part]
    rules = list(rules)
    z = rule_matrix(x, rules)
    keep = [j for j in range(z.shape[1]) if 0 < z[:, j].mean() < 1]
    _, first = np.unique(z[:, keep], axis=1, return_index=True)  # rules that hold for the same rows count once
    keep = [keep[j] for j in sorted(first)]
    w, b = lasso(z[:, keep], y, penalty)
    live = [j for j in range(len(keep)) if abs(w[j]) > 1e-6]
    return Rules(tuple(rules[keep[j]] for j in live), tuple(float(w[j]) for j in live), b)


def rule_leaves(x: np.ndarray, rules: list) -> np.ndarray:
    """For each row the number of the longest path that it follows (0: the root alone)."""
    leaf, depth = np.zeros(len(x), int), np.zeros(len(x), int)
    for j, rule in enumerate(rules):
        hit = rule_matrix(x, [rule])[:, 0].astype(bool) & (len(rule) > depth)
        leaf[hit], depth[hit] = j + 1, len(rule)
    return leaf


def rule_leaves_values(leaf: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    n = np.bincount(leaf)
    values = np.bincount(leaf, weights=fitted) / np.maximum(n, 1)
    return np.append(values, np.zeros(10_000))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> Rules:
    rows = statistics(labelled(docs, labels, "quality", limit), keep=("y",)).drop("doc_id").toArrow()  # ``limit`` rows of numbers
    x = np.column_stack([rows[s].to_numpy() for s in STATS])
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # not the order in which executors answered
    return fit(x[order], (y[order] > 0).astype(float))


def score(df: DataFrame, rules: Rules, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""
    return statistics(df, text, id).select("doc_id", rules.column().alias("score"))


@F.arrow_udf(StructType([StructField(s, DoubleType()) for s in STATS]))
def statistics_struct(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in statistics_of(texts).T], STATS)


def accepted(df: DataFrame, rules: Rules, least: float = LEAST) -> DataFrame:
    """The rows of df with a score of ``least`` at least, all columns unchanged, whatever their names."""
    frugal(df.sparkSession)
    (name,) = unused(df, "_stats")
    return df.withColumn(name, statistics_struct(F.col("text").cast("string"))).where(rules.column(f"{name}.") >= least).select(*[F.col(f"`{c}`") for c in df.columns])


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
