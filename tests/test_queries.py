import duckdb
import pytest

from rscframe.plans import oracles, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(oracles.SQL[name])
    assert sorted(want.columns) == cols
    rows = want.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in rows), key=str)
