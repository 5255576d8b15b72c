"""Hand-made rows for the rules that are easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from cutline.functions import ranks, text
from cutline.operators import cleaning, features, metrics, profile, recommend, reshape, sampling, vocab
from cutline.session import materialise
from tests.conftest import rows

ALLOTMENT = (
    "id INT, institute_type STRING, institute_short STRING, program_name STRING, "
    "degree_short STRING, category STRING, quota STRING, pool STRING, year INT, "
    "round_no INT, is_preparatory INT, opening_rank INT, closing_rank INT"
)


def allotment(spark, *changes):
    base = dict(
        institute_type="IIT", institute_short="X", program_name="P", degree_short="B",
        category="GEN", quota="AI", pool="Gender-Neutral", year=2020, round_no=6,
        is_preparatory=0, opening_rank=10, closing_rank=20,
    )
    names = [part.strip().split(" ")[0] for part in ALLOTMENT.split(",")]
    data = [tuple({"id": i, **base, **c}[n] for n in names) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, ALLOTMENT)


def test_rank_and_round_filters(spark):
    df = allotment(
        spark, {}, {"closing_rank": 9}, {"opening_rank": 0}, {"opening_rank": -1},
        {"round_no": 5}, {"round_no": 7}, {"round_no": None}, {"is_preparatory": None},
        {"is_preparatory": 1}, {"degree_short": None}, {"quota": None},
    )
    assert [r[0] for r in rows(cleaning.clean_jee(df), "id")] == [0, 5, 9]
    counts = cleaning.audit(df).first()
    assert (counts.raw_rows, counts.clean_rows, counts.dropped_rows) == (11, 3, 8)


def test_aliases_and_links(spark):
    df = allotment(
        spark, {"category": " ews "}, {"category": "open"}, {"category": "OPEN (PwD)"},
        {"degree_short": " [B.Tech](http://B.Tech)", "pool": None, "category": "SC"},
    )
    got = rows(cleaning.normalise_allotment(df), "id", "category", "degree_short", "pool")
    assert [g[1] for g in got] == ["GEN-EWS", "GEN", "OPEN (PWD)", "SC"]
    assert got[3][2:] == ("B.Tech", "Gender-Neutral")
    female = allotment(spark, {"pool": "Female-only (including x)"})
    assert cleaning.normalise_allotment(female).first().pool == "Female-Only"


def test_required_pool_null_is_dropped(spark):
    assert cleaning.clean_jee(allotment(spark, {"pool": None})).count() == 0


def build(spark, *changes):
    clean = cleaning.clean_jee(allotment(spark, *changes))
    return features.with_difficulty(features.jee_base(clean))


def test_single_year(spark):
    row = build(spark, {}).first()
    assert row.closing_rank_std == 0.0 and row.trend_direction == "UNKNOWN"
    assert row.yoy_rank_change is None and row.difficulty_pct == 0.0
    assert row.rank_pressure == 2.0


def test_null_key_has_no_trend(spark):
    years = [{"degree_short": None, "year": y} for y in (2019, 2020)]
    row = build(spark, *years).first()
    assert row.years_available == 2
    assert row.trend_direction is None and row.yoy_rank_change is None
    clean = cleaning.clean_jee(allotment(spark, *years))
    assert features.jee_base(clean, null_safe=True).first().trend_direction == "STABLE"


@pytest.mark.parametrize("step,label", [(50, "STABLE"), (51, "UP"), (-50, "STABLE"), (-51, "DOWN")])
def test_trend_limits_and_year_gap(spark, step, label):
    row = build(
        spark, {"year": 2019, "closing_rank": 500}, {"year": 2021, "closing_rank": 500 + step}
    ).first()
    assert (row.yoy_rank_change, row.trend_direction) == (step, label)


def test_bad_numbers(spark):
    df = spark.createDataFrame([("--",), ("",), ("12a",), ("1.01",), ("NaN",), (None,)], "r STRING")
    assert [r.x for r in df.select(ranks.as_number("r").alias("x")).collect()] == [
        None, None, None, 1.01, None, None
    ]


def test_white_space(spark):
    df = spark.createDataFrame([("\t a\nb\r \n",)], "t STRING")
    got = df.select(text.strip_all("t").alias("s"), text.one_line("t").alias("l")).first()
    assert (got.s, got.l) == ("a\nb", "a b")


def test_lag_fill(spark):
    data = [("A", "c", "GM", y, r) for y, r in ((1, 10.0), (2, 20.0), (3, 40.0))]
    data.append(("B", "c", "GM", 1, 10.0))
    df = spark.createDataFrame(
        data, "college_name STRING, course_name STRING, category STRING, year INT, rank DOUBLE"
    )
    yearly = features.comedk_yearly(features.comedk_valid(df))
    got = rows(features.with_previous_year(yearly), "college_name", "year", "prev_year_closing_rank")
    assert got == [("A", 1, 15.0), ("A", 2, 10.0), ("A", 3, 20.0), ("B", 1, 10.0)]
    stats = features.history_stats(yearly, 2026).filter("college_name = 'A'").first()
    assert stats.prev_year_closing_rank == 40.0 and stats.earliest_year == 2023
    assert abs(stats.closing_rank_std - 12.472191289246) < 1e-9
    assert features.history_lists(yearly).filter("college_name = 'A'").first().history == [
        10.0, 20.0, 40.0
    ]


@pytest.mark.parametrize("ratio,negatives", [(1.5, 1), (0.2, 1), (3.0, 3)])
def test_negative_ratio(spark, ratio, negatives):
    df = spark.createDataFrame(
        [("a", 0.0, 5.0), ("b", 9.0, 5.0)], "k STRING, opening_rank_min DOUBLE, closing_rank_max DOUBLE"
    )
    got = sampling.sample_eligibility(df, ["k"], ratio).collect()
    assert {r.k for r in got} == {"a"}
    assert sum(r.eligible == 0 for r in got) == negatives
    for r in got:
        low, high = (1, 5) if r.eligible else (6, 500_000)
        assert low <= r.student_rank <= high


def test_sample_beyond_limit(spark):
    df = spark.createDataFrame([("a", 1, 900_000)], "k STRING, opening_rank_min INT, closing_rank_max INT")
    ranks_drawn = {r.eligible: r.student_rank for r in sampling.sample_eligibility(df, ["k"]).collect()}
    assert ranks_drawn[0] == 900_001 and 1 <= ranks_drawn[1] <= 900_000


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    for split in (
        lambda d: sampling.split_by_hash(d, ["id"]),
        lambda d: sampling.split_stratified(d, "label", ["id"]),
        lambda d: sampling.assign_folds(d, ["id"], 5).withColumnRenamed("fold", "is_test"),
    ):
        assert rows(split(df.repartition(3)), "id", "is_test") == rows(
            split(df.repartition(11)), "id", "is_test"
        )
    counts = sampling.split_stratified(df, "label", ["id"]).groupBy("label").agg(
        F.sum("is_test").alias("t"), F.count("*").alias("n")
    )
    assert all(r.t == -(-r.n * 15 // 100) for r in counts.collect())


def test_stratified_on_copies_and_one_label(spark):
    df = spark.range(1000).select(F.lit(7).alias("id"), F.lit(1).alias("label"))
    got = sampling.split_stratified(df, "label", ["id"])
    assert got.count() == 1000 and got.agg(F.sum("is_test")).first()[0] == 150


@pytest.mark.parametrize("digits,cut_rows", [(4, 10_000), (1, 5), (16, 0)])
def test_stratified_radix_rounds(spark, monkeypatch, digits, cut_rows):
    """Any labels, several rounds, a hot label, and NULL; the cut is that of the sorted digests."""
    import hashlib
    import math

    monkeypatch.setattr(sampling, "DIGITS", digits)
    monkeypatch.setattr(sampling, "CUT_ROWS", cut_rows)
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 7)
    )
    df = materialise(spark.range(800).select("id", label.alias("label")))
    got = sampling.split_stratified(df, "label", ["id"]).collect()
    assert len(got) == 800
    by = {}
    for r in got:
        by.setdefault(r.label, []).append((hashlib.md5(f"42|{r.id}".encode()).hexdigest(), r.is_test))
    for part in by.values():
        part.sort()
        take = math.ceil(len(part) * 15 / 100)
        assert [t for _, t in part] == [1] * take + [0] * (len(part) - take)


def test_probability_tiers(spark):
    df = spark.createDataFrame(
        [(0.69996,), (0.69994,), (0.40,), (0.3999,)], "eligibility_prob DOUBLE"
    )
    got = rows(recommend.with_probability_tier(df))
    assert got == [(0.4, "Likely"), (0.6999, "Likely"), (0.7, "Safe")]


def catalogue(spark, preds):
    return spark.createDataFrame(
        [("GM", f"i{n}", "c", float(p)) for n, p in enumerate(preds)],
        "category STRING, institute STRING, course STRING, pred DOUBLE",
    )


def answer(spark, rule, rank, preds, limit=None):
    asked = spark.createDataFrame([("GM", rank)], "category STRING, user_rank INT")
    got = recommend.recommend_by_gap(
        asked, catalogue(spark, preds), ["category"], "user_rank", "pred",
        ["institute", "course"], rule, limit,
    ).collect()
    return sorted((r.tier, r.pos, r.institute) for r in got)


def test_neet_tier_limits(spark):
    got = answer(spark, recommend.NEET_RULE, 5000, [5000.5, 5000, 3500.5, 3500])
    assert got == [("Likely", 1, "i1"), ("Likely", 2, "i2"), ("Safe", 1, "i0")]


def test_comedk_tier_limits(spark):
    got = answer(spark, recommend.COMEDK_RULE, 5000, [5000.9, 4000.2, 3999.9, 5001])
    assert got == [("Likely", 1, "i1"), ("Likely", 2, "i0"), ("Safe", 1, "i3")]
    assert answer(spark, recommend.COMEDK_RULE, 500, [1, 0.5]) == [("Likely", 1, "i0")]


@pytest.mark.parametrize("rule", [recommend.NEET_RULE, recommend.KCET_RULE, recommend.COMEDK_RULE])
@pytest.mark.parametrize("limit", [None, 3])
def test_gap_tiers_equal_brute_force(spark, rule, limit):
    import random

    dice = random.Random(3)
    preds = [dice.choice([dice.uniform(1, 20000), 5000.0, dice.randint(1, 9000)]) for _ in range(200)]
    asked = [1, 700, 5000, 9000, 30000]
    requests = spark.createDataFrame([("GM", r) for r in asked], "category STRING, user_rank INT")
    got = recommend.recommend_by_gap(
        requests, catalogue(spark, preds), ["category"], "user_rank", "pred",
        ["institute", "course"], rule, limit,
    ).collect()
    want = set()
    for r in asked:
        tiers = {"Safe": [], "Likely": []}
        for n, p in enumerate(preds):
            p = int(p) if rule.whole else p
            if p > r:
                tiers["Safe"].append((p, f"i{n}"))
            elif (p >= max(1, r - rule.window)) if rule.whole else (p > r - rule.window):
                tiers["Likely"].append((p, f"i{n}"))
        for tier, found in tiers.items():
            found.sort(key=lambda t: (-t[0] if rule.descending else t[0], t[1]))
            want |= {(r, tier, i + 1, name) for i, (_, name) in enumerate(found[:limit])}
    assert {(g.user_rank, g.tier, g.pos, g.institute) for g in got} == want


def test_request_without_result(spark):
    asked = spark.createDataFrame(
        [(1, "GM", 100), (2, "XX", 100), (3, None, 100)], "id INT, category STRING, user_rank INT"
    )
    cat = catalogue(spark, [200, 300])
    bounds = recommend.tier_bounds(asked, cat, ["category"], "user_rank", "pred", recommend.NEET_RULE)
    got = rows(
        recommend.request_summary(asked, bounds, ["category"], "user_rank"),
        "id", "n_safe", "n_likely", "has_result",
    )
    assert got == [(1, 2, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_unseen_values(spark):
    seen = spark.createDataFrame([(" a ",), ("B",), (None,)], "institute STRING")
    df = spark.createDataFrame([("A",), ("b",), ("new",)], "institute STRING")
    known = vocab.build_vocabulary(seen, "institute", with_unknown=True)
    assert rows(known, "value", "id") == [("A", 0), ("B", 1), ("__UNKNOWN__", 2)]
    coded = vocab.lookup_or_unknown(df, "institute", known, "code")
    assert rows(coded, "institute", "code") == [("A", 0), ("b", 1), ("new", 2)]
    plain = vocab.build_vocabulary(seen, "institute")
    coded = vocab.lookup_or_unknown(df, "institute", plain, "code")
    assert rows(coded, "institute", "code") == [("A", 0), ("b", 1), ("new", 0)]
    assert rows(vocab.keep_known(df, "institute", plain)) == [("A",), ("b",)]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert reshape.keep_present(df, ["b", "z", "a"]).columns == ["b", "a"]
    assert reshape.add_missing(df, ["a", "z"]).first() == (1, 0)
    assert reshape.unpivot_courses(df.withColumn("c", F.lit("x"))).count() == 0
    assert reshape.drop_copies(df.union(df), ["a"]).count() == 1
    assert profile.preview(df.union(df), ["a"], 1).count() == 1


def test_legacy_defaults(spark):
    df = allotment(
        spark, {"degree_short": "b.tech + m.tech", "quota": "hs", "category": "GEN-EWS-PWD"},
        {"degree_short": None, "year": 2018},
    )
    full = {r.id: r for r in features.legacy_features(df).collect()}
    assert (full[0].is_dual_degree, full[0].is_home_state, full[0].is_pwd, full[0].is_ews) == (1, 1, 1, 1)
    assert (full[1].is_dual_degree, full[0].year_offset, full[1].year_offset) == (0, 2, 0)
    bare = features.legacy_features(df.drop("round_no", "year")).first()
    assert abs(bare.round_norm - 6 / 7) < 1e-12 and bare.year_offset == 0


def test_segment(spark):
    df = spark.createDataFrame([("IIT B", " iit "), ("NIT K", "x")], "institute_short STRING, institute_type STRING")
    assert rows(cleaning.with_segment(df), "institute_type") == [("IIT",), ("X",)]
    bare = cleaning.with_segment(df.drop("institute_type"))
    assert rows(bare, "institute_short", "institute_type") == [("IIT B", "IIT"), ("NIT K", "NIT")]


def test_nested_response_json(spark):
    asked = spark.createDataFrame([("GM", 100)], "category STRING, user_rank INT")
    top = recommend.recommend_by_gap(
        asked, catalogue(spark, [90, 200, 300]), ["category"], "user_rank", "pred",
        ["institute", "course"], recommend.NEET_RULE, 15,
    )
    row = recommend.nested_response(
        top, ["category", "user_rank"], ["institute", "course", "predicted_cutoff"]
    ).first()
    answer = json.loads(row.response)
    assert [e["institute"] for e in answer["Safe"]] == ["i2", "i1"]
    assert answer["Likely"] == [
        {"pos": 1, "institute": "i0", "course": "c", "predicted_cutoff": 90}
    ]


def test_top_overall(spark):
    df = spark.createDataFrame(
        [("r", f"i{n:02}", 0.39995 if n == 0 else 0.3 if n == 1 else 0.5 + n / 1000) for n in range(40)],
        "request STRING, name STRING, eligibility_prob DOUBLE",
    )
    got = recommend.top_overall(df, ["request"], ["name"]).orderBy("pos").collect()
    assert [r.name for r in got] == [f"i{n:02}" for n in range(39, 19, -1)]
    every = recommend.top_overall(df, ["request"], ["name"], limit=100)
    assert every.count() == 39


def test_metrics_on_known_rows(spark):
    df = spark.createDataFrame(
        [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "label INT, score DOUBLE"
    )
    assert metrics.exact_auc(df, "label", "score").first().auc == 0.875
    report = {r["class"]: r for r in metrics.classification_report(df, "label", "score").collect()}
    assert (report[1].precision, report[1].recall, report[0].recall, report[1].support) == (1, 0.5, 1, 2)
    one_class = metrics.exact_auc(df.filter("label = 1"), "label", "score").first()
    assert one_class.auc is None and one_class.n_positive == 2
    weights = sampling.with_class_weight(df.union(df.filter("label = 0")), "label")
    assert rows(weights.select("label", "weight").distinct()) == [(0, 1.0), (1, 2.0)]


def test_request_keys_do_not_collide(spark):
    from cutline.functions.text import request_key

    rows = [("A", None, "B"), ("A", "B", None), ("A_B", "", "C"), ("A", "B_", "C"), ("A", "B", "C"), ("A", "\\N", "B")]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING")
    keys = [r.k for r in df.select(request_key("jee", "a", "b", "c").alias("k")).collect()]
    assert len(set(keys)) == len(rows) and "jee_A_B_C" in keys


def test_as_of_features_do_not_see_their_own_rank(spark):
    from cutline.operators import features

    rows = [("c", "k", "GM", y, r) for y, r in ((2020, 10.0), (2021, 20.0), (2022, 40.0))] + [("c", "m", "GM", 2021, 7.0)]
    names = "college_name STRING, course_name STRING, category STRING, year INT, closing_rank DOUBLE"

    def of(values):
        got = features.comedk_features(spark.createDataFrame(values, names), as_of=True).collect()
        return {(r.course_name, r.year): {k: v for k, v in r.asDict().items() if k != "closing_rank"} for r in got}

    before = of(rows)
    for k, (*seat, rank) in enumerate(rows):
        changed = of([*rows[:k], (*seat, rank + 1000), *rows[k + 1 :]])
        assert changed[seat[1], seat[3]] == before[seat[1], seat[3]]
    assert before["k", 2020]["prev_year_closing_rank"] is None
    assert before["k", 2022]["college_avg_rank"] == pytest.approx(37 / 3)


@pytest.mark.parametrize("rule", [recommend.NEET_RULE, recommend.COMEDK_RULE])
def test_pages_and_intervals_give_the_whole_answer(spark, rule, monkeypatch):
    """All pages, the published table, and shared JSON pages each rebuild every row."""
    import random

    monkeypatch.setattr(recommend, "BLOCK", 7)
    dice = random.Random(5)
    preds = [dice.choice([dice.uniform(1, 9000), 5000.0, 5000.5]) for _ in range(150)]
    bad = spark.createDataFrame(
        [("GM", "null", "c", None), ("GM", "nan", "c", float("nan")), (None, "lost", "c", 1.0)],
        "category STRING, institute STRING, course STRING, pred DOUBLE",
    )
    offered = catalogue(spark, preds).unionByName(bad)
    asked = spark.createDataFrame(
        [("GM", r) for r in (1, 4999, 5000, 5001, 99999, None, 5000)] + [("none", 5), (None, 5)],
        "category STRING, user_rank INT",
    )
    names = ["institute", "course"]
    answers = recommend.interval_answers(asked, offered, ["category"], "user_rank", "pred", names, rule)
    want = rows(answers.every(), "user_rank", "tier", "pos", "institute")
    assert {i for *_, i in want}.isdisjoint({"null", "nan", "lost"}) and {r for r, *_ in want} >= {1, 5000}
    flat = rows(recommend.recommend_by_gap(asked, offered, ["category"], "user_rank", "pred", names, rule),
                "user_rank", "tier", "pos", "institute")
    assert flat == want
    size = 40
    read = [t for k in range(5) for t in rows(answers.page(k, size), "user_rank", "tier", "pos", "institute")]
    assert sorted(read) == want
    table = recommend.published(answers, names, "pred")
    order = {r.place: r.institute for r in table.filter("part = 'catalogue'").collect()}
    runs = table.filter("part = 'answer'").collect()
    assert sorted(
        (r.user_rank, r.tier, p - r["first"] + 1, order[p]) for r in runs for p in range(r["first"], r["last"] + 1)
    ) == want
    pages = recommend.response_pages(answers.placed, ["category"], "place", names, 11)
    assert pages.agg(F.max("n_rows")).first()[0] == 11
    back = recommend.read_pages(pages, ["category"], "place BIGINT, institute STRING, course STRING")
    assert {r.place: r.institute for r in back.collect()} == order


def test_answers_without_requests_or_catalogue(spark):
    names = ["institute", "course"]
    asked = spark.createDataFrame([("GM", 5)], "category STRING, user_rank INT")
    for requests, offered in ((asked, catalogue(spark, [9]).limit(0)), (asked.limit(0), catalogue(spark, [9]))):
        answers = recommend.interval_answers(
            requests, offered, ["category"], "user_rank", "pred", names, recommend.KCET_RULE
        )
        assert answers.intervals().count() == answers.page(0, 5).count() == 0


def test_every_request_gets_every_programme_of_its_cohort(spark, monkeypatch):
    from cutline.operators import joins

    monkeypatch.setattr(joins, "TILE", 3)
    asked = spark.createDataFrame(
        [(r, "JEE Main", "GEN", "ai", "gender-neutral") for r in range(20)] * 2 + [(1, "JEE Main", None, "ai", "x")],
        "user_rank INT, exam_type STRING, category STRING, quota STRING, pool STRING",
    )
    offered = spark.createDataFrame(
        [("NIT", f"n{k}", "gen", "AI", "Gender-Neutral") for k in range(17)] + [("IIT", "i", "gen", "AI", "Gender-Neutral")],
        "institute_type STRING, institute_short STRING, category STRING, quota STRING, pool STRING",
    )
    got = recommend.jee_matches(asked, offered, ["user_rank", "exam_type", "category", "quota", "pool"])
    pairs = {(int(r.request_key.split("_")[1]), r.institute_short) for r in got.collect()}
    assert pairs == {(r, f"n{k}") for r in range(20) for k in range(17)} and got.count() == len(pairs)
    assert recommend.jee_matches(asked.limit(0), offered, asked.columns).count() == 0


@pytest.mark.parametrize("name", ["tier_neet", "tier_kcet", "tier_comedk", "tier_order", "tier_order_asc"])
def test_tier_queries_hold_a_row_per_request_and_programme(spark, name):
    from cutline.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    ends = {"tier_order": "tier_order_ends", "tier_order_asc": "tier_order_asc_ends"}
    short = QUERIES[ends.get(name, f"{name}_intervals")](spark, sf)
    size = F.sum("n_rows") if name in ends else F.sum(F.col("last") - F.col("first") + 1)
    whole = QUERIES[name](spark, sf)
    assert whole.count() == short.agg(size).first()[0] > 0
    assert {"institute", "course", "predicted_cutoff"} <= set(whole.columns)


@pytest.mark.parametrize("files", [2, 32])
def test_csv_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch, files):
    """Also with more folders than files that a task may hold open."""
    from pyspark.sql import DataFrameWriter

    from cutline.sources import readers, writers

    limits, write = [], DataFrameWriter.csv

    def watched(self, *args, **kw):
        limits.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "csv", watched)
    monkeypatch.setattr(writers, "OPEN_FILES", files)
    df = spark.range(100).select("id", (2000 + F.col("id") % 7).alias("part"))
    writers.write_csv(df, str(tmp_path / "out"), ["part"])
    assert limits == [str(files)] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = readers.with_source_year(
        readers.read_csv(spark, str(tmp_path / "out"), "id LONG", recursive=True), str(tmp_path / "out")
    )
    assert {(r.id, r.year) for r in back.collect()} == {(k, 2000 + k % 7) for k in range(100)}
    assert back.count() == 100
