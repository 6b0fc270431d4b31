"""The registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from helixframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each kind; the driver holds all of them against their SQL.
SOME = ["kmer_document_frequency", "consensus_states", "weighted_resolve", "adaptive_rescue", "molecule_usa", "state_matrices", "intron_flanks", "best_alignment", "rank_correlation", "truth_strata"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, DATA)
    want = con.sql(catalogue.SQL[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_state_metrics_of_repeated_ids(spark, tmp_path):
    """Rows that repeat an id, as in tables made larger by copies, count as rows."""
    import duckdb

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.unionByName(events).unionByName(events.limit(10)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalogue.SQL["state_metrics"])
    assert catalogue.QUERIES["state_metrics"](spark, str(tmp_path)).first().asDict() == dict(zip(want.columns, want.fetchall()[0]))


def test_contract():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(catalogue.QUERIES) <= set(names)


def test_flagship_runs(spark):
    assert {"gene", "cell", "total"} <= set(entry.entry(spark).columns)
