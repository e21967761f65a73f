"""Exact components of near copies: MinHash keys propose pairs, full shingle sets confirm them.

1. ``sketch``: each text's distinct shingles (64-bit hashes), their number, a 128-bit digest of the
   set, and a few collections of ``width`` minima each.
2. Texts of one set are a class; only class representatives go on (least id).
3. Tensored banding: with ``m`` collections there is a table for each pair of collections, m(m-1)/2
   in all, whose keys combine the two collections' values.  So 16 collections of 3 minima (48 MinHash
   values) serve 120 tables of 6 minima (720 values if drawn apart).  A pair of documents shares a
   table as soon as it agrees on two collections; at Jaccard 0.85 all tables miss it
   with a probability of 7e-6.  A collection value that occurs once can be in no shared key, so only
   values seen twice are combined.  Without ``tensored`` each collection is a plain band.
4. In each bucket one member, the most central (it agrees with most others on most collections, as the
   text does that others were copied from), is paired with each member of another component, not members with each other.  Pairs
   whose minima agree too rarely for the wanted similarity (probability below 1e-7) are left
   out; the rest are confirmed on full sets and components are formed.  This is done with a twelfth of the tables, then with all.
5. Documents in buckets that still hold several components are taken again: they are dealt out by single collections (at most ``collections`` copies
   of each, not one for each table), and in each such bucket, in blocks of bounded size, pairs from
   different components that share a table are compared, in the first collection on which they agree, by a sketch of the whole set: the set is cut into BINS ranges of the hash,
   and four bits of each range's least value are kept.  This costs nothing beside the set; for small sets it is the set itself.  Pairs that
   agree too rarely for the wanted similarity (by six deviations) are left out, the rest are compared on full sets, so that no link between components is lost.
   In a bucket whose members are joined already there is nothing left to find, however many copies it holds.
6. Full sets and minima are compared by hubs: of a pair the end with more pairs is the head; a head is sent once for each GROUP of its pairs, and each
   other end once a pair, so that no row holds two sets, and a head with a million pairs is many groups.

This finds components, not each link.  ``links`` compares every pair of every bucket in the same way, and counts.

Links are confirmed by whole numbers: 100 * intersection >= percent * union.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import _PLACE, Permutations, Workspace, arrow_map, mix, segments, shingle_hashes, string_buffers, word_hashes

BINS, GROUP = 1024, 256
MOST_SENT = 2_000_000  # ids (16 bytes each in the hash table) that may be broadcast


@dataclass(frozen=True)
class Plan:
    size: int  # words in a shingle
    percent: int  # least similarity
    collections: int = 16
    width: int = 3
    seed: int = 7
    tensored: bool = True
    block: int = 1024  # rows of a bucket that are compared at a time
    rounds: int = 2  # of stars

    @property
    def minima(self) -> int:
        return self.collections * self.width

    def least_agree(self, n: int) -> int:
        """Agreements of n minima below which a pair of the wanted similarity comes with probability < 1e-7."""
        p, tail = self.percent / 100, 0.0
        for k in range(n):
            tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
            if tail > 1e-7:
                return k
        return n


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text (A-Z in lower case)."""
    data, offs = string_buffers(column)
    for a, b in segments(data, offs):
        words, at = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lower=True)
        for r in range(b - a):
            s = np.sort(shingle_hashes(words[at[r] : at[r + 1]], size))
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_ONES = np.uint64(0x1111111111111111)


def ranges(shingles: np.ndarray) -> bytes:
    """Four bits of the least of the sorted hashes in each of BINS ranges; 0 for an empty range, else 1 to 15."""
    if not len(shingles):
        return bytes(BINS // 2)
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    there = (at < len(shingles)) & (least - _EDGES < _EDGES[1])  # a range's hashes are less than one width above its edge
    value = np.where(there, (least >> np.uint64(8)) % np.uint64(15) + np.uint64(1), np.uint64(0)).astype(np.uint8)
    return (value[0::2] | value[1::2] << 4).tobytes()


def nibbles(x: np.ndarray) -> np.ndarray:
    """How many of the four-bit values of each row are not 0."""
    x = x | x >> np.uint64(1)
    return np.bitwise_count((x | x >> np.uint64(2)) & _ONES).sum(axis=-1, dtype=np.int64)


def alike(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: int, percent: int) -> np.ndarray:
    """Which rows of x may be as similar to y, by their ranges and the sizes of the sets.

    The least hashes of the E ranges that are not empty in both are those of E random members of the union, drawn without replacement.  A pair that is just
    similar enough has a union of known size, so that the number of equal ranges has a known mean and variance; pairs six deviations and one below are left out.
    """
    there = nibbles(x | y)
    equal = there - nibbles(x ^ y)
    common = np.ceil(percent * (nx + ny) / (100 + percent))
    union = np.maximum(nx + ny - common, 1)
    share = np.minimum(common / union, 1)
    spread = np.sqrt(there * share * (1 - share) * np.maximum(union - there, 0) / np.maximum(union - 1, 1))
    return equal >= there * share - 6 * spread - 1


def sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), bands (a value for each collection), minima."""

    def run(batches):
        perms = Permutations(plan.minima, plan.seed)
        for b in batches:
            counts, digests, minima = [], [], []
            for s in shingle_sets(b.column(1), plan.size):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                minima.append(perms.minima(s))
            least = np.array(minima, np.uint64).reshape(-1, plan.collections, plan.width)
            bands = mix((least * _PLACE[: plan.width]).sum(axis=2, dtype=np.uint64)).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * plan.collections), pa.array(bands.ravel()))
            minima = [m.astype(np.uint16).tobytes() for m in minima]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), bands, pa.array(minima, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "bands", "minima"],
            )

    return arrow_map(docs, run, "doc_id long, n_shingles long, set_id binary, bands array<long>, minima binary")


def bucket_keys(reps: DataFrame, plan: Plan) -> DataFrame:
    """(key, number t of the table, id) for each table and class representative that can share a bucket."""
    values = reps.select("id", F.posexplode("bands").alias("i", "v"))
    shared = values.groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1").select("i", "v")
    values = values.join(shared, ["i", "v"])
    if not plan.tensored:
        return values.select(F.xxhash64("i", "v").alias("key"), F.col("i").alias("t"), "id")
    own = values.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"))  # at most ``collections`` each
    pairs = F.expr("flatten(transform(vs, (x, k) -> transform(slice(vs, k + 2, size(vs)), y -> struct(xxhash64(x.i, y.i, x.v, y.v) as key, x.i * 64 + y.i as t))))")
    return own.where("size(vs) > 1").select(F.explode(pairs).alias("p"), "id").select("p.key", "p.t", "id")


def shares(reps: DataFrame, plan: Plan) -> DataFrame:
    """(id, n): with how many representatives, summed over the collections, each agrees."""
    values = reps.select("id", F.posexplode("bands").alias("i", "v"))
    counts = values.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1")
    return values.join(counts, ["i", "v"]).groupBy("id").agg(F.sum("c").alias("n"))


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) of the nodes of the edges (a, b): least id reachable, by large and small stars."""
    now, before = work.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        sym = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        new = work.cut(small)
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(now)
        if before is not None and sums == before:
            return new.select(F.col("b").alias("id"), F.col("a").alias("component"))
        now, before = new, sums


def similar(x: np.ndarray, y: np.ndarray, plan: Plan) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < plan.percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= plan.percent * (len(x) + len(y) - both)


def compared(pairs: DataFrame, table: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) that pass ``test(head's value, other's value)`` on a column of the table (id, ...).

    Of a pair the end with more pairs is the head.  Heads are sent once for each GROUP of their pairs and stand before them.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    rows = pairs.join(ends.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    first = F.col("na") >= F.col("nb")
    rows = rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.greatest("na", "nb").alias("n"))
    rows = rows.select("head", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP)).alias("part"), "id")
    value = table.select("id", F.col(column).alias("value"))
    tails = rows.join(value, "id").select("head", "part", F.lit(1).alias("kind"), "id", "value")
    heads = rows.select("head", "part").distinct().join(value.withColumnRenamed("id", "head"), "head").select("head", "part", F.lit(0).alias("kind"), F.col("head").alias("id"), "value")
    both = heads.union(tails).repartition("head", "part").sortWithinPartitions("head", "part", "kind").select("head", "id", "kind", "value")

    def run(batches):
        head, own = None, None
        for batch in batches:
            a, b = [], []
            for h, i, kind, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if kind == 0:
                    head, own = h, v.as_py()  # a copy: the batch goes
                elif h == head and test(own, v.as_buffer()):
                    a.append(min(h, i))
                    b.append(max(h, i))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return arrow_map(both, run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return compared(pairs, sets, "shingles", lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), plan))


def likely(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose minima agree often enough."""
    least = plan.least_agree(plan.minima)
    return compared(pairs, reps, "minima", lambda x, y: np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) >= least)


def in_blocks(members: DataFrame, plan: Plan, *columns: str) -> DataFrame:
    """(key, p, q, own, id and the columns) dealt by groups (key, p, q).

    A bucket is cut into blocks of about ``plan.block`` rows; each pair of blocks is a group of its
    own, so that no task holds a whole bucket.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    rows = members.join(sizes, "key").withColumn("k", F.ceil(F.col("n") / plan.block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", *columns)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def first_shared(agree: np.ndarray, t: int, plan: Plan) -> np.ndarray:
    """Of rows of agreements by collection: whether a table is shared, and collection t is the first that agrees."""
    return (agree.argmax(axis=1) == t) & agree[:, t] & (agree.sum(axis=1) >= (2 if plan.tensored else 1))


def across(members: DataFrame, plan: Plan) -> DataFrame:
    """Likely pairs of different components within a bucket of a collection: rows (key, t, id, component, ranges, bands, size).

    A pair that shares several buckets comes out of one: that of the first collection on which it agrees.  A bucket is compared in blocks (see ``in_blocks``).
    """
    rows = in_blocks(members, plan, "component", "ranges", "t", "bands", "size")

    def compare(group: list) -> list[tuple[int, int]]:
        ids, comps, own = (np.array([g[k] for g in group]) for k in (0, 1, 3))
        if comps.min() == comps.max():
            return []
        out = []
        same_block = own.min() == own.max()
        sigs = np.stack([np.frombuffer(g[2], np.uint64) for g in group])
        bands, t, sizes = np.array([g[5] for g in group]), group[0][4], np.array([g[6] for g in group], np.int64)
        for r in range(len(group) - 1):
            hit = comps[r + 1 :] != comps[r]
            if not same_block:
                hit &= own[r + 1 :] != own[r]
            rest = np.flatnonzero(hit) + r + 1
            if len(rest):
                rest = rest[first_shared(bands[rest] == bands[r], t, plan)]
            if len(rest):
                rest = rest[alike(sigs[rest], sigs[r], sizes[rest], sizes[r], plan.percent)]
                out += [(int(min(ids[r], x)), int(max(ids[r], x))) for x in ids[rest]]
        return out

    def run(batches):
        key, group, found = None, [], set()
        for batch in batches:
            for k, p, q, own, i, c, m, t, bands, size in zip(*(col.to_pylist() for col in batch.columns)):
                if (k, p, q) != key:
                    found.update(compare(group) if len(group) > 1 else ())
                    key, group = (k, p, q), []
                group.append((i, c, m, own, t, bands, size))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found)], ["a", "b"])
                found = set()
        found.update(compare(group) if len(group) > 1 else ())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found)], ["a", "b"])

    return arrow_map(rows, run, "a long, b long").distinct()


def link_counts(members: DataFrame, plan: Plan) -> DataFrame:
    """(id, n): how many copies the sets have that are similar enough to each set, of rows (key, t, id, ranges, bands, shingles, copies).

    Every pair of a bucket is compared, whatever is linked already: in one of the buckets it shares by its minima, and if these
    are alike enough on full sets.  Only sums leave a group.
    """
    rows = in_blocks(members, replace(plan, block=min(plan.block, 256)), "ranges", "t", "bands", "shingles", "copies")  # sets take room

    def compare(group: list) -> list[tuple[bytes, int]]:
        own, copies, bands = (np.array([g[k] for g in group]) for k in (1, 6, 4))
        sigs, sets = np.stack([np.frombuffer(g[2], np.uint64) for g in group]), [np.frombuffer(g[5], np.uint64) for g in group]
        same_block, n, sizes = own.min() == own.max(), np.zeros(len(group), np.int64), np.array([len(x) for x in sets])
        for r in range(len(group) - 1):
            rest = np.arange(r + 1, len(group)) if same_block else np.flatnonzero(own[r + 1 :] != own[r]) + r + 1
            if len(rest):
                rest = rest[first_shared(bands[rest] == bands[r], group[0][3], plan)]
            if len(rest):
                rest = rest[alike(sigs[rest], sigs[r], sizes[rest], sizes[r], plan.percent)]
            for x in rest.tolist():
                if similar(sets[r], sets[x], plan):
                    n[r] += copies[x]
                    n[x] += copies[r]
        return [(group[r][0], int(n[r])) for r in np.flatnonzero(n)]

    def run(batches):
        def out(group):
            pairs = compare(group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], ["id", "n"])

        key, group = None, []
        for batch in batches:
            for k, p, q, own, i, m, t, bands, shingles, copies in zip(*(col.to_pylist() for col in batch.columns)):
                if (k, p, q) != key:
                    yield out(group)
                    key, group = (k, p, q), []
                group.append((i, own, m, t, bands, shingles, copies))
        yield out(group)

    return arrow_map(rows, run, "id binary, n long").groupBy("id").agg(F.sum("n").alias("n"))


def links(df: DataFrame, plan: Plan, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(set_id, links): with how many other rows a row of each set is linked directly, equal ones included; rows without an id do not count."""
    work = Workspace(df.sparkSession)
    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    classes = sketch(docs, plan).where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("bands").alias("bands"))
    classes = work.cut(classes)
    keys = work.cut(bucket_keys(classes.select(F.col("set_id").alias("id"), "bands"), replace(plan, tensored=False)))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = keys.join(sizes, "key")
    wanted = classes.join(keys.select(F.col("id").alias("set_id")).distinct(), "set_id", "left_semi")

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(0), plan.size))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([ranges(s) for s in sets], pa.binary())], ["set_id", "shingles", "ranges"])

    # of an id that is repeated with other texts each set is taken
    sets = arrow_map(docs.join(wanted.select("doc_id").distinct(), "doc_id").select("text"), run, "set_id binary, shingles binary, ranges binary")
    sets = work.cut(sets.groupBy("set_id").agg(F.first("shingles").alias("shingles"), F.first("ranges").alias("ranges")).join(wanted, "set_id"))
    members = keys.join(sets.select(F.col("set_id").alias("id"), "ranges", "bands", "shingles", "copies"), "id")
    n = work.cut(link_counts(members, plan))
    return classes.join(n.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))


def components(df: DataFrame, plan: Plan, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, set_id, component_id, kept of every row.

    A null id is linked with nothing and kept; rows of one id are one node and stay or go together; texts
    without words have no shingles, are linked with nothing and are kept.
    """
    work = Workspace(df.sparkSession)
    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketched = work.cut(sketch(docs, plan))
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.min("minima").alias("minima"))
    reps = work.cut(classes)
    # an id that is repeated with other texts is one node, with the minima of one of them
    sigs = work.cut(reps.groupBy("id").agg(F.max_by(F.struct("bands", "minima"), "set_id").alias("x")).select("id", "x.bands", "x.minima"))
    keys = work.cut(bucket_keys(sigs.select("id", "bands"), plan))

    # Stars first: in each open bucket its most central member (that agrees with most others on most
    # collections, as the text does that the others were copied from) against the members of other components.
    central = shares(sigs, plan)
    keys = work.cut(keys.join(central, "id").select("key", "t", "id", F.struct(F.col("n"), (-F.col("id")).alias("o")).alias("rank")))
    edges, comps, tested = None, None, None
    for turn in range(plan.rounds):
        named = keys if comps is None else keys.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if comps is None:
            named = named.where(F.pmod("key", F.lit(12)) == 0).withColumn("component", F.col("id"))
        heads = named.groupBy("key").agg(F.max_by(F.struct("id", "component"), "rank").alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "h")
        stars = named.join(heads, "key").where("component <> h.component").select(F.least("h.id", "id").alias("a"), F.greatest("h.id", "id").alias("b")).distinct()
        if tested is not None:
            stars = stars.join(tested, ["a", "b"], "left_anti")
        pairs = work.cut(likely(stars, sigs, plan))
        tested = pairs if tested is None else tested.union(pairs)
        sets = set_table(docs, both_ends(pairs), plan, work)
        found = work.cut(confirmed(pairs, sets, plan))
        work.drop(sets)
        edges = found if edges is None else edges.union(found)
        comps = connected(edges, work)

    # What is still open is compared in full.
    named = keys.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = work.cut(named.join(open_, "key").select("id", "component").distinct())
    sets = set_table(docs, left, plan, work)
    single = work.cut(bucket_keys(sigs.select("id", "bands").join(left, "id", "left_semi"), replace(plan, tensored=False)).join(left, "id"))
    open_ = single.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = single.join(open_, "key").join(sets.select("id", "ranges", F.floor(F.length("shingles") / 8).alias("size")).join(sigs.select("id", "bands"), "id"), "id")
    more = work.cut(across(members, plan).join(tested, ["a", "b"], "left_anti"))
    edges2 = work.cut(confirmed(more, sets, plan))
    comps = connected(edges.union(edges2), work)

    named = reps.select("set_id", "id").join(comps, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    work.drop(keys, more, left, single, sets)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "set_id", "component_id", "kept")


def set_table(docs: DataFrame, wanted: DataFrame, plan: Plan, work: Workspace) -> DataFrame:
    """(id, shingles, ranges) of the wanted documents; of several texts under an id the set that sorts last.

    Up to MOST_SENT ids (counted first) go to the texts; beyond, both are joined by a shuffle.
    """

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), plan.size))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([ranges(s) for s in sets], pa.binary())], ["id", "shingles", "ranges"])

    ids = work.cut(wanted.select(F.col("id").alias("doc_id")).distinct())
    few = ids.count() <= MOST_SENT
    sets = arrow_map(docs.join(F.broadcast(ids) if few else ids, "doc_id"), run, "id long, shingles binary, ranges binary")
    out = work.cut(sets.groupBy("id").agg(F.max(F.struct("shingles", "ranges")).alias("x")).select("id", "x.shingles", "x.ranges"))
    work.drop(ids)
    return out


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))
