import numpy as np

from rscframe.llm import linking


def drawn(rng, both: int, each: int):
    """Two sorted sets of random hashes with ``both`` in common and ``each`` of their own."""
    u = rng.integers(0, 2**64, both + 2 * each, dtype=np.uint64)
    return np.sort(u[: both + each]), np.sort(np.concatenate([u[:both], u[both + each :]]))


def test_ranges_hold_the_least_hash_of_each_range():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 20_000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        got = np.frombuffer(linking.ranges(s), np.uint8)
        got = np.stack([got & 15, got >> 4], axis=1).ravel()
        want = np.zeros(linking.BINS, int)
        for h in s[::-1].tolist():
            want[h >> 54] = (h >> 8) % 15 + 1
        assert got.tolist() == want.tolist()
        assert linking.nibbles(np.frombuffer(linking.ranges(s), np.uint64)) == (want > 0).sum()


def test_ranges_keep_pairs_of_the_wanted_similarity_and_refute_others():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for union in (40, 400, 4000):
            kept = {}
            for alike in (percent, percent - 15):
                both = -(-union * alike // 100)
                both += (union - both) % 2
                pairs = [drawn(rng, both, (union - both) // 2) for _ in range(200)]
                x, y = (np.stack([np.frombuffer(linking.ranges(p[k]), np.uint64) for p in pairs]) for k in (0, 1))
                kept[alike] = np.mean([linking.alike(x[i : i + 1], y[i], np.array([len(pairs[i][0])]), len(pairs[i][1]), percent)[0] for i in range(200)])
            assert kept[percent] == 1 and kept[percent - 15] < 0.1, kept


def test_pairs_are_compared_whatever_end_has_more_of_them(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(400).tolist()
    table = spark.createDataFrame([(i, bytes([i % 3])) for i in ids], "id long, value binary")
    pairs = {(min(ids[0], i), max(ids[0], i)) for i in ids[1:]} | {(min(a, b), max(a, b)) for a, b in rng.integers(0, 400, (300, 2)).tolist() if a != b}
    got = linking.compared(spark.createDataFrame(sorted(pairs), "a long, b long"), table, "value", lambda x, y: bytes(x) == bytes(y)).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(p for p in pairs if p[0] % 3 == p[1] % 3)
