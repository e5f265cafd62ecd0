"""Every query with SQL against DuckDB on the smallest tables, and rows of the others."""

import glob
import os

import duckdb
import pytest

from netweft.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def table(t):
    names = sorted(t.column_names)
    return names, sorted(zip(*[t.column(n).to_pylist() for n in names]), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toArrow()
    theirs = duck.sql(catalog.SQL[name]).to_arrow_table()
    assert table(ours) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_samples_are_the_references(spark):
    """260 sources (here all nodes with an edge, if fewer) and 20 hops; 100 probes."""
    from netweft.plans import graphs as P

    v, e = P._vec(spark, SF)
    nodes = e.select("src").union(e.select("dst")).distinct().count()
    shells = catalog.QUERIES["bfs_shells_260"](spark, SF).collect()
    assert len({r["source"] for r in shells}) == min(260, nodes)
    assert max(r["d"] for r in shells) > 4
    assert max(r["d"] for r in catalog.QUERIES["correlator_vs_distance_260"](spark, SF).collect()) > 4
    few, many = (catalog.QUERIES[n](spark, SF).first()["points"] for n in ("hausdorff_dim", "hausdorff_dim_100"))
    assert many > 5 * few


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
