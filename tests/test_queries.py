"""Every registered query of the library's own operators against its SQL on DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import Row

from cliploom import jobs
from cliploom.jobs import bindings

#: Those that SQL can't say, with the test that holds them against a restatement.
OTHERWISE = {"normalize_caption", "silence_dp_cuts", "align_words_to_lines", "curation_pass"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in bindings.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Row):
        return plain(v.asDict())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def test_all_but_the_listed_queries_have_sql():
    assert set(jobs.QUERIES) - set(jobs.ORACLES) == OTHERWISE


@pytest.mark.parametrize("name", sorted(jobs.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = jobs.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(jobs.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(OTHERWISE))
def test_query_runs(spark, sf_dir, name):
    assert jobs.QUERIES[name](spark, sf_dir).count() >= 0


def test_quota_intake_takes_every_clip_on_one_side(spark, sf_dir, monkeypatch):
    from cliploom.jobs import queries_mining as M

    given = {}
    real = M.Q.quota_intake
    monkeypatch.setattr(M.Q, "quota_intake", lambda new, held, *a: given.update(new=new, held=held) or real(new, held, *a))
    jobs.QUERIES["quota_intake"](spark, sf_dir)
    sides = [{r.clip_id for r in given[k].select("clip_id").collect()} for k in ("new", "held")]
    every = M.I.signatures(jobs.Tables(spark, sf_dir).b_members)
    assert not sides[0] & sides[1] and sides[0] | sides[1] == {r.clip_id for r in every.select("clip_id").collect()}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
