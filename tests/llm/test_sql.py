"""The operators' queries against their SQL forms in DuckDB."""

import duckdb
import pytest
from conftest import DATA

from corvane.llm.queries import ORACLE, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda some: sorted(tuple(map(plain, r)) for r in some)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(found.fetchall())
