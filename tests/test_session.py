"""Shared scratch space."""

from pyspark.sql import functions as F

from cutline.session import RELEASE_SHUFFLES, materialise


def test_materialise_keeps_rows_and_settings(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count()
    for before in ("false", "true"):
        spark.conf.set(RELEASE_SHUFFLES, before)
        kept = materialise(rows)
        assert spark.conf.get(RELEASE_SHUFFLES) == before
        assert sorted(kept.collect()) == sorted(rows.collect()) == sorted(kept.collect())
    spark.conf.unset(RELEASE_SHUFFLES)
    # the plan that was written still runs, also when it is part of another
    assert kept.join(rows, ["x", "count"]).count() == 7
