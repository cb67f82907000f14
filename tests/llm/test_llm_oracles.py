"""Every corpus query that has SQL gives the SQL's rows on the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import registry

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_warc", "op4_licence_scans", "op5_suffix_array_dedup", "op9_decontamination"])
def test_query_equals_sql_on_hostile_texts(spark, tmp_path, name):
    from test_llm import SCHEMA, fixture_rows

    from tessera.llm import licences

    rows = fixture_rows()
    notices = [n for n, _ in licences.TEMPLATES.values()]
    rows += [(900 + k, " x ".join(notices[k : k + 3]) + " mozilla domain creative", "en", None, 1, "") for k in range(len(notices))]
    # the SQL of op2, op3 and op5 takes ids for granted
    seen = set()
    sure = [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    whole = rows if name in ("op4_licence_scans", "op9_decontamination") else sure
    spark.createDataFrame(whole, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[2], r[1]) for r in sure], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    items = [(1, " ".join(fixture_rows()[0][1].split(" ")[20:45])), (2, "gnu"), (3, None), (4, "--"), (10, "Licensed under the")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    result = con.execute(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*[c[0] for c in result.description])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, result.fetchall()))
