"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased, runs of other characters become one space, and its 1- to 3-grams
(within words, with a space on either side) are ranked by frequency.  A language's profile holds its
RANKS most frequent n-grams; the out-of-place distance sums, over the text's RANKS most frequent n-grams, the difference
of ranks, or RANKS for an n-gram that the profile lacks.  The least distance wins; ties go to the lesser name.

Profiles are counted over at most LEARN_ROWS rows with a language whose crc32 remainder is not 2.

score: 1 - best / second distance, stretched to 0..1 by a factor of two; with one learned language, 1 - distance / worst.
Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from .textkit import arrow_map, frugal, held_out, release, table

RANKS, LEARN_ROWS = 300, 8_000
#: Score from which the pipeline keeps a document.
STAGE_SCORE = 0.02
_S1, _S2 = np.uint64(21), np.uint64(42)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text as numbers, ascending, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word stays, as a space
    chars = np.where(letter, codes, 32)[keep].astype(np.uint64)
    chars = np.concatenate([[np.uint64(32)], chars, [np.uint64(32)]])
    if chars[-2] == 32:
        chars = chars[:-1]
    solid = chars != 32
    two = (chars[:-1] << _S1) | chars[1:]
    three = (two[:-1] << _S1) | chars[2:]
    all_ = np.concatenate([chars[solid], two | (np.uint64(1) << _S2), three[solid[1:-1]] | (np.uint64(1) << np.uint64(63))])
    all_.sort()
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.diff(np.append(first, len(all_)))


def top(codes: np.ndarray, counts: np.ndarray, k: int = RANKS) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties by number."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


def learn_profiles(df: DataFrame, limit: int = LEARN_ROWS, ranks: int = RANKS) -> dict[str, list[int]]:
    """Profiles of all languages among the learned rows; what comes to the driver is ``ranks`` n-grams a language."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for b in batches:
            parts: dict[str, list] = {}
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(l, []).append(grams(t or ""))
            for l, xs in parts.items():
                codes = np.concatenate([x[0] for x in xs])
                order = np.argsort(codes, kind="stable")
                codes, counts = codes[order], np.concatenate([x[1] for x in xs])[order]
                if len(codes):
                    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(first)), pa.array(codes[first].view(np.int64)), pa.array(np.add.reduceat(counts, first))], ["lang", "gram", "n"])

    counted = arrow_map(rows.join(F.broadcast(chosen), "doc_id").select("text", "lang"), run, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    unsigned = F.expr("case when gram >= 0 then 0 else 1 end")
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), unsigned, "gram")
    best = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranks).select("lang", "gram", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Judge:
    """Profiles as one sorted table of n-grams and a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS):
        self.names, self.worst = sorted(profiles), ranks
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.rank = np.full((len(self.known) + 1, max(len(self.names), 1)), -1, np.int64)
        for l, name in enumerate(self.names):
            at = np.searchsorted(self.known, np.array(profiles[name], np.int64).view(np.uint64))
            self.rank[at, l] = np.arange(len(at))

    def __call__(self, text: str | None) -> tuple[str, float]:
        ranked = top(*grams(text or ""), self.worst)
        if not len(ranked) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.known, ranked)
        at[self.known[np.minimum(at, len(self.known) - 1)] != ranked] = len(self.known)
        theirs = self.rank[at]
        apart = np.abs(theirs - np.arange(len(ranked))[:, None])
        apart[theirs < 0] = self.worst
        total = apart.sum(axis=0)
        best = int(total.argmin())
        most = self.worst * len(ranked)
        second = np.delete(total, best).min() if len(total) > 1 else most
        return self.names[best], float(min(1.0, 2 * (1 - total[best] / second))) if second else 0.0


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches):
        judge = Judge(profiles)
        for b in batches:
            got = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = df.schema[id].dataType.simpleString()
    return arrow_map(df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def identified(df: DataFrame, profiles: dict[str, list[int]], least: float = STAGE_SCORE) -> DataFrame:
    """The rows of df whose language is told with a score of ``least`` at least, all columns unchanged."""

    frugal(df.sparkSession)

    @F.arrow_udf(BooleanType())
    def keep(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(profiles)
        for texts in parts:
            got = (judge(t.as_py()) for t in texts)
            yield pa.array([name != "und" and score >= least for name, score in got], pa.bool_())
        release()

    return df.where(keep(F.col("text").cast("string")))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn_profiles(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
SQL: dict[str, str] = {}
