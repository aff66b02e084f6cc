"""Every registered query against the SQL that says the same, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strataloom.operators import queries as core
from strataloom.plans import linkage_queries, retrieval_queries, source_queries, text_queries

MODULES = [core, text_queries, retrieval_queries, linkage_queries, source_queries]
PAIRS = [(n, m) for m in MODULES for n in m.SQL]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cell = lambda v: "-" if v is None or v is pd.NA or v != v else f"{v:.5g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") and type(v).__name__ not in ("bool", "bool_") else str(v)
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name,module", PAIRS, ids=[n for n, _ in PAIRS])
def test_equals_sql(spark, sf, duck, name, module):
    got, want = module.QUERIES[name](spark, sf).toPandas(), duck.execute(module.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["ret08_approximate_knn", "ret16_related_by_terms", "txt12_snippet", "res02_additional_values", "src10_page_documents", "src24_checksums"])
def test_runs(spark, sf, name):
    for m in MODULES:
        if name in m.QUERIES:
            assert m.QUERIES[name](spark, sf).count() >= 0
