"""Parts of the operators' results against their SQL, on the smallest tables."""

import duckdb
import pytest

from lodestone.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_part_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, DIR), con.sql(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda rows: sorted((tuple(round(float(r[c]), 4) + 0.0 if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=str)
    assert plain([r.asDict() for r in got.collect()]) == plain(want.astype(object).to_dict("records"))


def test_every_operator_is_registered():
    assert [sum(k.startswith(f"op{n}_") for k in registry.QUERIES) for n in range(1, 11)] == [1] * 10
