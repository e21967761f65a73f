"""Document fingerprints: MinHash over five-word shingles.

``fingerprints`` gives one signature per text: ``permutations`` universal hash functions over the
text's shingles in vectorised numpy, 16 bits of each minimum, as hexadecimal text.  Shingles are
runs of five words in text order, the first ones padded at the start of the text, so that short texts have a
set as large as their word count too.  ``near_pairs`` joins signature bands in Spark and confirms
each pair of the linked classes by Jaccard similarity of the full sets (see ``linking``).

Defined results: a null text counts as empty; an empty text (or one of white space only) has the
signature of the empty set, which is like nothing but itself; equal texts have equal
fingerprints; rows are never merged, so repeated rows return repeated rows; rows of one doc_id follow each other in
the order of their text; a null doc_id sorts last; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import linking
from .textkit import Permutations, arrow_map, segments, shingle_hashes, string_buffers, table, word_hashes

PERMUTATIONS, SHINGLE, SEED = 64, 5, 11
MOST_RANGES = 50_000
_PAD = np.arange(1, SHINGLE, dtype=np.uint64)


def padded_shingles(words: np.ndarray) -> np.ndarray:
    return shingle_hashes(np.concatenate([_PAD, words]), SHINGLE) if len(words) else words


def signatures(column: pa.Array, perms: Permutations) -> np.ndarray:
    """A row of ``perms.count`` 16-bit minima for each text."""
    data, offs = string_buffers(column)
    out = np.empty((len(offs) - 1, perms.count), np.uint16)
    for a, b in segments(data, offs):
        words, at = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lower=False)
        for r in range(b - a):
            out[a + r] = perms.minima(padded_shingles(words[at[r] : at[r + 1]])).astype(np.uint16)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal minima, an estimate of the Jaccard similarity."""
    return (x == y).mean(axis=1)


def hexed(sigs: np.ndarray) -> pa.Array:
    return pa.array([s.astype(">u2").tobytes().hex() for s in sigs], pa.string())


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches):
        perms = Permutations(permutations, seed)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), hexed(signatures(b.column(1), perms))], ["doc_id", "fingerprint"])

    kind = df.schema[id].dataType.simpleString()
    return arrow_map(df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, fingerprint string")


def near_pairs(df: DataFrame, text: str = "text", id: str = "doc_id", percent: int = 80) -> DataFrame:
    """Near copies by signature bands (see ``linking``): doc_id, n_shingles, component_id, kept, links of every row.

    ``links``: the number of other rows that are linked with it directly, equal ones included; 0 without an id or words.
    """
    plan = linking.Plan(size=SHINGLE, percent=percent, collections=21, width=3, seed=SEED, tensored=False)
    n = linking.links(df, plan, text=text, id=id)
    out = linking.components(df, plan, text=text, id=id).join(n, "set_id", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.col("links"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", F.coalesce(found, F.lit(0)).alias("links"))


def with_successor(df: DataFrame, id: str = "doc_id", text: str = "text", per_bucket: int = 512) -> DataFrame:
    """Each row with the text that follows it in descending id order (``next``; after the last: the first).

    Ids are cut into ranges of about ``per_bucket`` rows at quantiles; a range is sorted alone, and
    the head of each range is sent to the range before it too.  Only the cut points, whose number is
    the number of rows over ``per_bucket`` and MOST_RANGES at most, come to the driver.
    """
    spark = df.sparkSession
    low = -(2**63)
    rows = df.select(F.coalesce(F.col(id).cast("long"), F.lit(low)).alias("_key"), F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = df.count()
    n = int(max(1, min(total // per_bucket, MOST_RANGES)))
    cuts = sorted({int(x) for x in rows.approxQuantile("_key", [k / n for k in range(1, n)], max(0.25 / n, 1e-5))}) if n > 1 else []
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("_bucket", bucket("_key"))
    # The ids alone are read here; heads has a row for each range.
    heads = {r["_bucket"]: r["_head"] for r in rows.groupBy("_bucket").agg(F.max("_key").alias("_head")).collect()}
    order = sorted(heads, reverse=True)
    sent = [(heads[b], before) for before, b in zip([order[-1], *order], order)] if order else []
    guests = spark.createDataFrame(sent, "_key long, _to int")  # a row for each range: at most MOST_RANGES + 1
    both = rows.join(F.broadcast(guests), "_key", "left").select("_key", "doc_id", "text", F.explode(F.expr("if(_to is null, array(struct(_bucket as b, 0 as g)), array(struct(_bucket as b, 0 as g), struct(_to as b, 1 as g)))")).alias("_x"))
    w = Window.partitionBy("_b").orderBy("_g", F.col("_key").desc(), "text")
    return both.select("_key", "doc_id", "text", F.col("_x.b").alias("_b"), F.col("_x.g").alias("_g")).withColumn("next", F.lead("text").over(w)).where("_g = 0").select("doc_id", "text", "next")


def edited_report(df: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""

    def run(batches):
        perms = Permutations(permutations, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = b.column(1).to_pylist()
                heads = b.column(2).to_pylist()
                edited = [t[: len(t) - len(t) // 3] + h[: len(t) // 3] for t, h in zip(texts, heads)]
                x, y, z = (signatures(c, perms) for c in (b.column(1), pa.array(edited, pa.string()), b.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), hexed(x), hexed(y), pa.array(likeness(x, y)), pa.array(likeness(x, z))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return arrow_map(with_successor(df), run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_report(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
SQL: dict[str, str] = {}
