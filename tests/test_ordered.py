"""Exact ranks against brute force, with ties, NULL keys, negatives and a hot group."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutline.operators import joins, ordered
from cutline.operators.joins import product
from cutline.operators.ordered import (
    count_below,
    exact_medians,
    in_ranges,
    running_counts,
    with_percent_rank,
    with_position,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    dice = random.Random(7)
    data = []
    for i in range(3000):
        key = None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 5}")
        value = dice.choice([dice.uniform(-5e5, 5e5), float(dice.randint(-3, 3)), 1000.5])
        data.append((i, key, value))
    return spark.createDataFrame(data, "id INT, k STRING, v DOUBLE").repartition(5)


def test_running_counts(spark, sample):
    got = {
        (r.k, r.v): (r.n, r.n_below, r.n_total)
        for r in running_counts(sample, ["k"], "v").collect()
    }
    pdf = sample.toPandas()
    pdf["k"] = pdf["k"].astype(object).where(pdf["k"].notna(), None)
    for key in {None, "hot", "k0"}:
        part = pdf[pdf.k.isna()] if key is None else pdf[pdf.k == key]
        for value in part.v.unique()[:60]:
            want = ((part.v == value).sum(), (part.v < value).sum(), len(part))
            assert got[(key, value)] == want


@pytest.mark.parametrize("share", [1000, 20, 1])
def test_percent_rank_equals_window(spark, sample, monkeypatch, share):
    """Also where few or all values count as hot."""
    monkeypatch.setattr(ordered, "HOT_SHARE", share)
    sample.createOrReplaceTempView("sample_rows")
    want = spark.sql(
        "SELECT id, percent_rank() OVER (PARTITION BY k ORDER BY v) AS p FROM sample_rows"
    ).toPandas()
    got = with_percent_rank(sample, ["k"], "v", "p").toPandas()
    both = want.merge(got, on="id")
    assert len(both) == 3000
    assert (both.p_x - both.p_y).abs().max() < 1e-12


def test_percent_rank_of_one_row(spark):
    df = spark.createDataFrame([("a", 5.0)], "k STRING, v DOUBLE")
    assert with_percent_rank(df, ["k"], "v", "p").first().p == 0.0


def test_positions_equal_window(spark, sample):
    sample.createOrReplaceTempView("sample_rows")
    want = spark.sql(
        "SELECT id, row_number() OVER (PARTITION BY k ORDER BY v, id) AS pos FROM sample_rows"
    ).toPandas()
    both = want.merge(with_position(sample, ["k"], ["v", "id"]).toPandas(), on="id")
    assert len(both) == 3000 and (both.pos_x == both.pos_y).all()


def test_count_below(spark, sample):
    points = spark.createDataFrame(
        [("hot", 0.0), ("hot", 1000.5), ("k1", -1e9), ("none", 3.0)], "k STRING, v DOUBLE"
    )
    pdf = sample.toPandas()
    for r in count_below(points, sample, ["k"], "v").collect():
        part = pdf[pdf.k == r.k]
        assert (r.below, r.upto, r.total) == (
            (part.v < r.v).sum(), (part.v <= r.v).sum(), len(part)
        )


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False), st.integers(-5, 5)),
        min_size=1, max_size=40,
    )
)
def test_median(spark, values):
    numbers = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in numbers], "x DOUBLE")
    got = exact_medians(df, ["x"]).first().x
    want = pd.Series(numbers, dtype="float64").median()
    assert (got is None and want != want) or abs(got - want) < 1e-9


@pytest.fixture
def sixteen_ranges(spark):
    """Shuffles of 16 partitions that are not merged."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


VALUES = {
    "narrow": "1e6 + id / 1e9",
    "prefix": "concat('NATIONAL INSTITUTE OF TECHNOLOGY ', lpad(id, 9, '0'))",
    "copies": "7.0D",
}


@pytest.mark.parametrize("name", VALUES)
def test_ranges_hold_like_numbers_of_rows(spark, sixteen_ranges, name):
    """Narrow values, long common beginnings and copies do not meet in one task."""
    df = spark.range(20_000).selectExpr("id", f"{VALUES[name]} AS v")
    placed = with_position(df, [], ["v"])
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(1, 20_001))
    last = [F.rand(7).alias("r")] if name == "copies" else []
    parts = in_ranges(df.select("v", *last), ["v", *["r"][: len(last)]]).groupBy("__part").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 2 * 20_000 / 16


def test_sums_over_many_ranges(spark, sixteen_ranges, sample):
    """Groups that span ranges, and ranges that hold many groups."""
    test_running_counts(spark, sample)
    test_count_below(spark, sample)
    test_positions_equal_window(spark, sample)


@pytest.mark.parametrize("sizes", [(100, 7), (1, 5, 3), (4, 0), (1,)])
def test_product(spark, sizes):
    parts = [
        spark.range(n).select(F.col("id"), (F.col("id") * 2).alias(f"w{k}")) for k, n in enumerate(sizes)
    ]
    cells = product(parts)
    want = 1
    for n in sizes:
        want *= n
    assert cells.columns == [f"w{k}" for k in range(len(sizes))]
    assert cells.distinct().count() == cells.count() == want


def test_product_is_split_evenly(spark, monkeypatch):
    """Tasks follow the number of cells, not a part's size; a number without a row has no cells."""
    monkeypatch.setattr(joins, "CELLS_PER_TASK", 100)
    few = spark.range(2).select("id", F.lit("x").alias("a"))
    gap = spark.range(1000).filter("id % 10 <> 3").select("id", F.col("id").alias("b"))
    cells = product([few, gap])
    assert cells.count() == 1800
    parts = cells.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) <= 100


def test_positions_with_long_ties(spark):
    df = spark.range(600).select(
        F.lit("c").alias("k"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).cast("double").alias("v"),
        F.concat(F.lit("i"), F.col("id") % 20).alias("a"),
        F.col("id").alias("b"),
    )
    got = with_position(df, ["k"], ["v", "a", "b"]).collect()
    want = sorted(got, key=lambda r: (r.v, r.a, r.b))
    assert [r.pos for r in want] == list(range(1, 601))


def test_no_cross_join_or_whole_group_window(spark, sample):
    df = with_percent_rank(sample, ["k"], "v", "p")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_null_first_and_nan_last(spark):
    values = [5.0, None, 7.0, float("nan"), None, float("inf"), -float("inf"), float("nan"), -1.0, 7.0]
    df = spark.createDataFrame(list(enumerate(values)), "id INT, v DOUBLE").withColumn("k", F.lit("a"))
    df.createOrReplaceTempView("odd_rows")
    want = spark.sql(
        "SELECT id, row_number() OVER (ORDER BY v, id) AS pos, percent_rank() OVER (ORDER BY v) AS p FROM odd_rows"
    ).collect()
    places = {r.id: r.pos for r in with_position(df, ["k"], ["v", "id"]).collect()}
    shares = {r.id: r.p for r in with_percent_rank(df, ["k"], "v", "p").collect()}
    assert places == {r.id: r.pos for r in want}
    assert shares == pytest.approx({r.id: r.p for r in want})
