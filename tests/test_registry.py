"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from veinstone.functions import text as T
from veinstone.plans import more, registry, wide  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(more.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.Q[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(more.Q.keys() - more.SQL.keys()))
def test_runs(spark, sf, name):
    assert registry.Q[name](spark, sf).count() > 0


def test_low_information(spark):
    cases = {"": "empty", "test" * 40: "repetitive", "ab12" + " " * 220: "sparse", "1 2 3 4 5 6 7 8 9 0 " * 10: "numeric", "!!!": "no-text", "An ordinary line of prose.": "", "https://a.b/c and words\n- [x](https://d.e) goes on\n* https://f more": "link-heavy", "[a](b.md)\n[a](b.md)": "", ("A" * 70 + "\n") * 3: "blob-heavy"}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").select("text", "want", T.low_information(T.F.col("text")).alias("got")).collect()
    for r in rows:
        assert (r.want in r.got) if r.want else r.got == [], r


def test_redact(spark):
    lines = ['a token = "0123456789abcdef" b', "secret_key = abcdefgh", "cookie: sessionid1", "Authorization: Bearer abcdefgh12", "mytoken = plain1", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in lines], "text string").select(T.redact(T.F.col("text")).alias("t")).collect()]
    assert got == ['a token = "<REDACTED>" b', "secret_key = <REDACTED>", "cookie: <REDACTED>", "Authorization: Bearer <REDACTED>", "mytoken = plain1", "<REDACTED_PRIVATE_KEY>"]
