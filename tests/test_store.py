"""Reuse of answers in time, against a walk over the requests in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import cleaning, reshape, store
from cutline.session import materialise
from cutline.sources import readers
from tests.conftest import rows

START = dt.datetime(2024, 3, 1, 23, 0)


def batch(spark, asks):
    df = spark.createDataFrame(
        [(n, k, None if s is None else START + dt.timedelta(seconds=s)) for n, k, s in asks],
        "ask_id INT, request_key STRING, asked_at TIMESTAMP",
    )
    return materialise(df, "batch")


def replay(asks, last, ttl):
    """Time of issue and source of each request; ``last`` holds each key's newest answer."""
    out = {}
    for n, k, s in sorted((a for a in asks if a[1] is not None and a[2] is not None), key=lambda a: a[2]):
        if k not in last or s >= last[k] + ttl:
            last[k] = s
        out[n] = (last[k], "model" if last[k] == s else "cache")
    return out


@pytest.mark.parametrize("ttl", [3600, 50])
def test_serve(spark, tmp_path, ttl):
    dice, path, last = random.Random(4), str(tmp_path / "store"), {}
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    issued = 0
    for day in range(3):
        # One key has most of the requests, many of them in one second.
        asks = [(n, dice.choice(["hot"] * 4 + ["a", "b", "c"]), day * 20000 + dice.randrange(0, 15000, 7)) for n in range(300)]
        asks += [(300 + n, "hot", day * 20000 + 77) for n in range(40)]
        asks += [(400, None, 5), (401, "a", None)]
        calls = []

        def answer(wanted):
            calls.append(rows(wanted, "request_key"))
            two = F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")
            return wanted.select("request_key", two)

        got = store.serve(batch(spark, asks), path, answer, ttl).collect()
        want = replay(asks, last, ttl)
        assert {r.ask_id: (r.issued_at - base, r.source) for r in got} == want
        assert len(calls[0]) == len(set(calls[0]))  # a key is answered once a batch
        issued += len({(k, t) for (n, k, s) in asks if n in want for t, source in [want[n]] if source == "model"})
        kept = store.read_store(spark, path)
        assert kept.count() == 2 * issued  # both rows of every answer, once per issue
    assert {"issued_on=2024-03-01", "issued_on=2024-03-02"} <= {p.name for p in (tmp_path / "store").iterdir()}


def test_no_requests(spark, tmp_path):
    path = str(tmp_path / "store")
    none = batch(spark, []).limit(0)
    for _ in range(2):
        assert store.serve(none, path, lambda w: w.select("request_key")).count() == 0
    got = store.serve(batch(spark, [(1, "k", 5)]), path, lambda w: w.select("request_key")).collect()
    assert [r.source for r in got] == ["model"]


def test_empty_answers_are_kept(spark, tmp_path):
    """A request without any row is not asked again before its answer expires."""
    path, calls = str(tmp_path / "store"), []

    def answer(wanted):
        calls.append(wanted.count())
        return wanted.limit(0).select("request_key", F.lit(1).alias("pos"))

    first = store.serve(batch(spark, [(1, "k", 5)]), path, answer).collect()
    second = store.serve(batch(spark, [(2, "k", 1000), (3, "k", 4000)]), path, answer).collect()
    assert [r.source for r in first] == ["model"]
    assert {r.ask_id: r.source for r in second} == {2: "cache", 3: "model"}
    assert rows(store.read_store(spark, path), "pos") == [(None,), (None,)]


def test_audit_counts_files_without_a_year(spark, tmp_path):
    for name, lines in {"2020r1.csv": ["5,x", "0,x", ",x"], "other/late.csv": ["5,x", "6,"], "2021.csv": []}.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_text("\n".join(["Rank,Institute", *lines]) + "\n")
    raw = readers.read_csv(spark, str(tmp_path), "Rank DOUBLE, Institute STRING", recursive=True)
    told = rows(cleaning.audit_files(raw, str(tmp_path), cleaning.valid_neet()))
    assert told == [("2020r1.csv", 3, 3, 1, 2), ("other/late.csv", 2, 0, 0, 2)]


def test_years_and_narrow_files(spark, tmp_path):
    for name in ("comedk2022.csv", "comedk2026.csv", "comedkold.csv", "comedk2023.txt", "x2021.csv"):
        (tmp_path / name).write_text("a\n")
    assert readers.years_in(spark, str(tmp_path), "comedk") == [2022, 2026]
    assert readers.years_in(spark, str(tmp_path / "none"), "comedk") == []
    for width in (1, 2, 3):
        df = spark.createDataFrame([("x",) * width], ", ".join(f"c{k} STRING" for k in range(width)))
        long = reshape.unpivot_courses(df, names=["code", "name", "category"])
        assert long.columns == ["code", "name", "category", "course_name", "rank"] and not long.count()
