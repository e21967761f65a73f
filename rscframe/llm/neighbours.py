"""Approximate nearest neighbours by adaptive dimension scan in inverted lists.

``fit`` clusters at most FIT_ROWS vectors (k-means), draws a random rotation, and finds how many lists must
be probed for RECALL of the true neighbours within that sample.  Every vector is then assigned to its list.  Lists are dealt out in
chunks of about CHUNK vectors, so that a large list is many groups.  A query goes to all chunks of its probed lists.

Within a chunk the rotated vectors are scanned in blocks of BLOCK columns.  After each block, a candidate
whose distance as estimated from the columns so far is significantly above the query's tenth best is abandoned
(hypothesis test with EPSILON); survivors are measured exactly, in double precision, on the original vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those
whose length is not the most common one of the sample; rows that share the query's id are never its neighbours; ties go to the smaller id;
a query whose probed lists hold no more than ``k`` vectors goes to further lists, so fewer than ``k`` rows are returned
only if there are no more (or if more than one row has the query's id).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textkit import arrow_map, table

FIT_ROWS, MOST_LISTS, CHUNK, BLOCK, EPSILON, RECALL, K = 20_000, 4096, 2048, 16, 2.1, 0.985, 10


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def valid(df: DataFrame, id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    if df.schema[vector].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")  # nothing is lost of doubles and whole numbers
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def fit(rows: DataFrame, lists: int | None = None, seed: int = 3) -> Index | None:
    """None if there is no vector.  The sample is the rows with the least hash of the id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    got = sample["v"].to_pylist()
    if not got:
        return None
    sizes = [len(v) for v in got]
    d = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([v for v in got if len(v) == d], float)
    total = rows.count()
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    n = lists or (1 if total <= CHUNK else int(min(MOST_LISTS, max(8, total**0.5 / 4), len(x) // 8 + 1)))
    centres = x[rng.permutation(len(x))[:n]]
    for _ in range(12):
        own = distances(x, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    if len(centres) == 1:
        return Index(centres, rotation, 1)
    own = distances(x, centres).argmin(1)
    asked = rng.permutation(len(x))[:200]
    far = distances(x[asked], x)
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(far, min(K, len(x) - 1), axis=1)[:, :K]
    rank = distances(x[asked], centres).argsort(1).argsort(1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return Index(centres, rotation, int(needed[min(int(RECALL * len(needed)), len(needed) - 1)]) + 1)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def assigned(rows: DataFrame, index: Index, probes: int, sizes: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """Each row with the array of its ``probes`` nearest lists, and further ones until they hold ``least`` vectors by ``sizes``."""
    d = index.centres.shape[1]
    held = np.array([(sizes or {}).get(l, 0) for l in range(len(index.centres))], np.int64)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), d).astype(float)
            near = np.argsort(distances(x, index.centres), axis=1, kind="stable").astype(np.int32)
            n = np.minimum(np.maximum((np.cumsum(held[near], axis=1) < least).sum(axis=1) + 1, probes), near.shape[1])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[np.arange(near.shape[1]) < n[:, None]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["vec_id", "v", "lists"])

    return arrow_map(rows.where(F.size("v") == d), run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, lists array<int>")


def scan(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int):
    """(query id, id, distance) of each query's k nearest in a chunk."""
    d = x.shape[1]
    wide = x.astype(float)
    turned = np.asfortranarray(wide @ rotation)
    q_ids, q = queries
    q = q.astype(float)
    q_turned = q @ rotation
    out_q, out_i, out_s = [], [], []

    def exact(at: np.ndarray, j: int) -> np.ndarray:
        return np.sqrt(((wide[at] - q[j]) ** 2).sum(1))

    for j in range(len(q_ids)):
        others = np.flatnonzero(ids != q_ids[j])
        first, rest = others[: 4 * k], others[4 * k :]
        dist = exact(first, j)
        if len(rest) and len(first) >= k:
            limit = np.partition(dist, k - 1)[k - 1]
            part = np.zeros(len(rest))
            for c in range(0, d, BLOCK):
                part += ((turned[rest, c : c + BLOCK] - q_turned[j, c : c + BLOCK]) ** 2).sum(1)
                seen = min(c + BLOCK, d)
                slack = 1 + EPSILON / seen**0.5 if seen < d else 1 + 1e-9
                alive = np.sqrt(part * (d / seen)) <= slack * limit + 1e-12
                rest, part = rest[alive], part[alive]
                if not len(rest):
                    break
            first, dist = np.concatenate([first, rest]), np.concatenate([dist, exact(rest, j)])
        best = np.lexsort((ids[first], dist))[:k]
        out_q += [int(q_ids[j])] * len(best)
        out_i += ids[first][best].tolist()
        out_s += dist[best].tolist()
    return out_q, out_i, out_s


def search(df: DataFrame, queries: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows of df."""
    schema = "query_id long, vec_id long, score double"
    rows = valid(df, id, vector)
    index = fit(rows)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = index.centres.shape[1]
    owned = assigned(rows, index, 1).select("vec_id", "v", F.col("lists")[0].alias("list"))
    sizes = {r["list"]: r["n"] for r in owned.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    chunks = F.create_map(*[F.lit(int(x)) for l, n in sorted(sizes.items()) for x in (l, -(-n // CHUNK))])
    owned = owned.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks[F.col("list")]).cast("int")).withColumn("asks", F.lit(False))
    asked = assigned(valid(queries, id, vector), index, index.probes, sizes, k + 1).select("vec_id", "v", F.explode("lists").alias("list"))
    asked = asked.where(chunks[F.col("list")].isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks[F.col("list")] - 1).cast("int")))).withColumn("asks", F.lit(True))

    def run(batches):
        key, ids, xs = None, [], []
        asking_ids, asking = [], []

        def answer():
            nonlocal asking_ids, asking
            if asking_ids and ids:
                x, i = np.concatenate(xs), np.concatenate(ids)
                got = scan((np.concatenate(asking_ids), np.concatenate(asking)), i, x, index.rotation, k)
                asking_ids, asking = [], []
                return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])
            asking_ids, asking = [], []
            return None

        for b in batches:
            x, i = matrix(b.column(1), d), b.column(0).to_numpy()
            lists, chunk, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            change = np.flatnonzero((np.diff(lists) != 0) | (np.diff(chunk) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(i)]):
                if (now := (lists[lo], chunk[lo])) != key:
                    if (out := answer()) is not None:
                        yield out
                    key, ids, xs = now, [], []
                if asks[lo]:
                    asking_ids.append(i[lo:hi])
                    asking.append(x[lo:hi])
                    if sum(map(len, asking_ids)) > 4096 and (out := answer()) is not None:
                        yield out
                else:
                    ids.append(i[lo:hi])
                    xs.append(x[lo:hi])
        if (out := answer()) is not None:
            yield out

    both = owned.select("vec_id", "v", "list", "chunk", "asks").union(asked.select("vec_id", "v", "list", "chunk", "asks"))
    found = arrow_map(both.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "asks"), run, schema)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op9_neighbours": op9_neighbours}
SQL: dict[str, str] = {}
