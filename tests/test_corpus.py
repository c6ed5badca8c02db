import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rulemill.functions import text as T
from rulemill.operators import chunking, reports
from rulemill.plans import catalog

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_exact_keys(spark):
    given = ["SO 89", "so89A", "Standing  Order 12", "  22/5 ", "SO 89(1)", "SO", "standing order12"]
    assert one(spark, T.exact_section_key, *given) == ["so-89", "so-89a", "so-12", "22/5", None, None, None]
    assert one(spark, T.exact_citation, *given) == ["so89", "so89a", "so12", "22/5", None, None, None]


def test_singular(spark):
    given = dict(rulings="ruling", policies="policy", classes="class", cases="cas", status="statu", process="process", gas="gas", ties="ty", houses="hous", address="address")
    assert one(spark, T.singular, *given) == list(given.values())
    assert one(spark, T.singular_phrase, "points of order", "point of order", " closure  motions ", "") == ["point of order", None, "closure motion", None]


def test_packing():
    sizes = lambda *n: [(len(c), -(-len(c) // 4)) for c in chunking.pack(["x" * k for k in n])]
    assert sizes(700, 400, 300) == [(1101, 276), (300, 75)]
    assert sizes(1500, 100) == [(1500, 375), (100, 25)]
    assert sizes(600, 598) == [(1199, 300)]
    assert sizes(600, 599) == [(600, 150), (599, 150)]
    assert all(len(c) <= 1801 for c in chunking.pack(["ab cd. " * 900]))


def test_path_and_duplicates(spark):
    df = spark.createDataFrame([(["Chapter 1", "General", None, "General", " ", "SO 1", "General"],)], "p array<string>")
    assert df.select(T.distinct_path(F.col("p"))).first()[0] == ["Chapter 1", "General", "SO 1", "General"]
    with pytest.raises(ValueError):
        reports.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def rows(df):
    return sorted(tuple("" if pd.isna(x) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "events", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
