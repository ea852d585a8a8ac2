"""Queries against their SQL at sf0.01: those of the store, quotations and circles and a few others, all with ALL_QUERIES=1."""

import os

import duckdb
import pytest

from quillstone.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.01"
FEW = ("shingle_counts", "sentences", "entities", "page_text", "atomize_claims", "adjudicate", "gap_queries", "resolve_dates", "assess_credibility", "claims_upsert", "recall_claims", "store_find", "store_stats", "admit_citations", "phantom_rate", "connect_claims")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", [n for n in SQL if os.environ.get("ALL_QUERIES") or n in FEW])
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
