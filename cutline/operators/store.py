"""Answers kept with their time of issue and reused until they expire.

A request is served from the store if an answer to an equal request was issued less than ``ttl``
seconds before it; otherwise an answer is issued at that moment, and serves the requests that follow.
Requests come in batches, each later than the one before; the store is a table partitioned by the
day of issue, to which a batch appends.

Which requests issue an answer depends on the ones before, so a key's times are walked in order. They
are whole seconds, each once: a key's list is bounded by the seconds a batch spans, not by the number
of requests, and is counted on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators.ordered import attach
from cutline.session import materialise
from cutline.sources import writers

TTL = 3600  # fixed value: seconds for which an answer is reused


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored answers, or None before the first one (a folder may be there without a file)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def issue_times(asked: DataFrame, last: DataFrame | None, ttl: int = TTL) -> DataFrame:
    """Per ``request_key``: the seconds at which answers are issued, and the last earlier one.

    ``asked`` has (request_key, second), ``last`` the time of the newest stored answer per key.
    Columns: request_key, n (requests), known (may be NULL), issued (rising, may be empty).
    """
    seconds = asked.groupBy("request_key", "second").agg(F.count(F.lit(1)).alias("n"))
    times = seconds.groupBy("request_key").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list("second")).alias("times")
    )
    if last is None:
        times = times.withColumn("known", F.lit(None).cast("long"))
    else:
        times = times.join(last.select("request_key", F.col("issued_at").alias("known")), "request_key", "left")
    start = F.struct(F.col("known").alias("at"), F.array().cast("array<long>").alias("issued"))

    def step(held, t):
        fresh = held["at"].isNull() | (t >= held["at"] + ttl)
        new = F.struct(t.alias("at"), F.concat(held["issued"], F.array(t)).alias("issued"))
        return F.when(fresh, new).otherwise(held)

    issued = F.aggregate("times", start, step, lambda held: held["issued"])
    return times.select("request_key", "n", "known", issued.alias("issued"))


def serve(
    requests: DataFrame,
    path: str,
    answer: Callable[[DataFrame], DataFrame],
    ttl: int = TTL,
) -> DataFrame:
    """Serves a batch from the store at ``path`` and appends the answers it issues.

    ``requests`` (a written table) has ``request_key``, ``asked_at`` (timestamp) and whatever ``answer``
    needs: that function gets one row per key that needs an answer and gives its rows, by
    ``request_key``, or none. Returns the requests with ``issued_at`` (seconds) and ``source``: ``model`` for
    those in the second of issue, else ``cache``. Requests without a key or time are not served.
    """
    spark = requests.sparkSession
    asked = requests.filter(F.col("request_key").isNotNull() & F.col("asked_at").isNotNull())
    asked = asked.withColumn("second", F.unix_timestamp("asked_at"))
    stored, last = read_store(spark, path), None
    first = asked.agg(F.min("second")).first()[0]
    if stored is not None and first is not None:
        # Only days that may hold answers which have not expired are read.
        day = F.to_date(F.timestamp_seconds(F.lit(first - ttl)))
        recent = stored.filter(F.col("issued_on") >= day)
        last = recent.groupBy("request_key").agg(F.max("issued_at").alias("issued_at"))
    times = materialise(issue_times(asked.select("request_key", "second"), last, ttl), "issues")
    fresh = times.filter(F.size("issued") > 0)
    sample = F.min_by(F.struct(*[F.col(c) for c in requests.columns]), "second")
    wanted = asked.join(fresh.select("request_key"), "request_key", "left_semi")
    wanted = wanted.groupBy("request_key").agg(sample.alias("r")).select("r.*")
    moments = fresh.select("request_key", F.explode("issued").alias("issued_at"))
    # An empty answer is an answer: it is kept as one row without values.
    rows = moments.join(answer(wanted), "request_key", "left")
    rows = rows.withColumn("issued_on", F.to_date(F.timestamp_seconds("issued_at")))
    writers.append_parquet(rows, path, ["issued_on"])

    served = attach(materialise(asked, "asked"), times, ["request_key"])
    every = F.concat(F.filter(F.array("known"), lambda t: t.isNotNull()), "issued")
    before = F.filter(every, lambda t: t <= F.col("second"))
    # A request that comes in late, before all answers known, takes the first of them.
    at = F.coalesce(F.array_max(before), F.array_min(every))
    new = (at == F.col("second")) & F.array_contains("issued", at)
    return served.select(
        *requests.columns, at.alias("issued_at"), F.when(new, "model").otherwise("cache").alias("source")
    )
