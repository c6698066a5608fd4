"""Every catalogue query against its SQL in DuckDB, and the ones without SQL for shape."""

from pathlib import Path

import duckdb
import pytest

from pagelens.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def normal(df):
    names = sorted(df.columns)
    plain = df[names].astype(object).where(df[names].notna(), None)
    return names, sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert normal(catalog.QUERIES[name](spark, sf_dir).toPandas()) == normal(duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gbt_scores_all_labels(spark, tmp_path):
    rows = [(i, [float(i % 3), float(i % 3 == 1), 0.1 * (i % 7)], [0, 4, 12][i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["gbt_scores"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["label"]) for r in got) == sorted((i, c) for i in range(60) for c in ("0", "4", "12"))
    assert all((r["score"] > 0.5) == (rows[r["vec_id"]][2] == int(r["label"])) for r in got)
