"""The four pipelines over small hand-written files, from CSV to recommendations."""

import itertools

import pytest
from pyspark.sql import functions as F

from cutline.operators import features, models, recommend
from cutline.plans import pipelines
from cutline.session import materialise
from cutline.sources import catalog, readers, writers
from tests.conftest import rows

QUICK = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}


def save(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def jee_lines():
    yield (
        "id,year,institute_type,round_no,quota,pool,institute_short,program_name,"
        "program_duration,degree_short,category,opening_rank,closing_rank,is_preparatory"
    )
    n = 0
    for kind, inst, year, prog in itertools.product(
        ("IIT", "NIT"), range(6), (2019, 2020, 2021), ("CSE", "ME")
    ):
        close = 500 + 300 * inst + (200 if prog == "ME" else 0) + 40 * (year - 2019)
        n += 1
        yield (
            f"{n},{year}, {kind.lower()},6, ai,Gender-Neutral,{kind}{inst},{prog},4 Years,"
            f"[B.Tech](http://B.Tech),open,{close - 400},{close},0"
        )
    yield "9001,2021,IIT,5,AI,Gender-Neutral,IIT1,CSE,4 Years,B.Tech,OPEN,1,2,0"
    yield "9002,2021,IIT,6,AI,Gender-Neutral,IIT1,CSE,4 Years,B.Tech,OPEN,x,2,0"


def check_bands(spark, table, path, got):
    """A score per interval of ranks equals the score of the rank itself."""
    model, _ = models.load_artifacts(spark, path)
    programmes = readers.read_parquet(spark, table)
    points = models.split_points(model, "student_rank")
    assert 0 < len(points) < models.BINS
    for rank in (1.0, 100.0, points[0], points[0] + 1, points[-1], points[-1] + 5):
        direct = models.score_eligibility(model, programmes.withColumn("student_rank", F.lit(rank)))
        band = sum(p < rank for p in points)
        banded = recommend.score_bands(model, programmes).filter(F.col("band") == band)
        names = [*recommend.JEE_NAMES, "eligibility_prob"]
        assert rows(direct, *names) == rows(banded, *names)
        if rank == 100.0:
            want = {(r.institute_short, r.program_name): r.eligibility_prob for r in direct.collect()}
            assert all(want[r.institute, r.program] == r.eligibility_prob for r in got)
            assert len(got) == sum(v >= 0.4 for v in want.values())


def test_jee(spark, tmp_path):
    raw = save(tmp_path / "jee.csv", jee_lines())
    clean = str(tmp_path / "clean")
    counts = pipelines.ingest_jee(spark, raw, clean)
    assert (counts.raw, counts.clean, counts.dropped) == (74, 72, 2)
    first, rest = str(tmp_path / "f" / "iit"), str(tmp_path / "f" / "nit")
    pipelines.build_jee_features(spark, clean, first, rest)
    iit = readers.read_parquet(spark, first)
    assert iit.count() == 12 and readers.read_parquet(spark, rest).count() == 12
    assert {r.category for r in iit.collect()} == {"GEN"}
    assert iit.agg(F.min("difficulty_pct"), F.max("difficulty_pct")).first() == (0.0, 100.0)

    model = str(tmp_path / "model")
    report = pipelines.train_jee(spark, first, model, **QUICK)
    assert {r["class"] for r in report.collect()} == {0, 1}
    asked = spark.createDataFrame(
        [(1, 100, "JEE Advanced", "gen", "AI", "gender-neutral")] * 2
        + [(3, 100, "JEE Main", "GEN", "AI", "Gender-Neutral")],
        "request_id INT, user_rank INT, exam_type STRING, category STRING, quota STRING, pool STRING",
    )
    outcomes, answers = pipelines.recommend_jee(spark, asked, {"IIT": (first, model)})
    told = rows(outcomes, "request_id", "segment", "has_result")
    assert told == [(1, "IIT", 1), (1, "IIT", 1), (3, "NIT", 0)]
    got = recommend.jee_response_rows(answers.every()).collect()
    assert all(r.institute.startswith("IIT") and r.eligibility_prob >= 0.4 for r in got)
    sizes = outcomes.first()
    assert (sum(r.tier == "Safe" for r in got), sum(r.tier == "Likely" for r in got)) == (sizes.n_safe, sizes.n_likely)
    check_bands(spark, first, model, got)
    for tier in ("Safe", "Likely"):
        part = sorted((r.pos, r.eligibility_prob) for r in got if r.tier == tier)
        assert [p for p, _ in part] == list(range(1, len(part) + 1))
        assert [e for _, e in part] == sorted((e for _, e in part), reverse=True)


def test_neet(spark, tmp_path):
    header = "SNo,Rank,Allotted Quota,Institute,Course,Allotted Category,Candidate Category,Remarks"
    folder = tmp_path / "neet2099"
    folder.mkdir()
    for year in (2020, 2021):
        lines = [header] + [
            f"{i},{100 * i + year - 2019}.5,AI,Inst {i % 5},MBBS, open ,OP,ok" for i in range(1, 60)
        ]
        save(folder / f"{year}r2.csv", lines)
    save(folder / "raw.csv", [header, "1,5.0,AI,Inst 1,MBBS,OPEN,OP,no year in the name"])
    out = str(tmp_path / "clean")
    counts = pipelines.ingest_neet(spark, str(folder), out)
    assert counts.clean == 118
    clean = readers.read_parquet(spark, out)
    assert rows(clean.select("year", "category").distinct()) == [(2020, "OPEN"), (2021, "OPEN")]
    assert "candidate_category" in clean.columns
    table, model = str(tmp_path / "features"), str(tmp_path / "model")
    pipelines.build_neet_features(spark, out, table)
    pipelines.train_ranks(spark, table, model, models.NEET_SPEC, features.NEET_KEYS, **QUICK)
    asked = spark.createDataFrame(
        [(5000, "open"), (10, "open")], "candidate_rank INT, category STRING"
    )
    got = pipelines.recommend_neet(spark, asked, table, model).collect()
    low = [r for r in got if r.candidate_rank == 10]
    assert len(low) == 5 and {r.tier for r in low} == {"Safe"} and {r.course for r in low} == {"MBBS"}


def test_kcet(spark, tmp_path):
    header = "CollegeID,CollegeName,CourseName,Category,Cutoff_Rank,Year,Base_Category,Quota,Region"
    lines = [header, "E0,,CS,1,5,2023,GM,G,GEN", "E0,College 0,CS,1,0,2023,GM,G,GEN"]
    for c, course, year in itertools.product(range(6), ("CS", "ME"), (2022, 2023)):
        lines.append(f"E{c},College {c},{course}, 02 ,{1000 * (c + 1) + year - 2022},{year},gm,G,GEN")
    out = str(tmp_path / "clean")
    counts = pipelines.ingest_kcet(spark, save(tmp_path / "kcet.csv", lines), out)
    assert (counts.raw, counts.clean) == (26, 24)
    table, model = str(tmp_path / "features"), str(tmp_path / "model")
    pipelines.build_kcet_features(spark, out, table)
    assert {r.category for r in readers.read_parquet(spark, table).collect()} == {"02"}
    ranges = {"maxIter": (2, 3), "maxDepth": (2, 3), "stepSize": (0.1, 0.3)}
    report = pipelines.train_ranks(
        spark, table, model, models.KCET_SPEC, features.KCET_KEYS, ranges, 2, folds=2, in_ranks=True
    )
    assert report.first().rmse >= 0
    asked = spark.createDataFrame(
        [(1, "02", "gm", "g", "gen")],
        "user_rank INT, category STRING, base_category STRING, quota STRING, region STRING",
    )
    got = pipelines.recommend_kcet(spark, asked, table, model, limit=4).collect()
    assert sorted(r.pos for r in got) == [1, 2, 3, 4]
    cutoffs = [r.predicted_cutoff for r in sorted(got, key=lambda r: r.pos)]
    assert cutoffs == sorted(cutoffs, reverse=True)


def long_file(year):
    yield "College Code,College Name,Seat Category,Branch Name,Cutoff Rank"
    for c, cat in itertools.product(range(4), ("gm", "KKR", "other")):
        yield f'E{c},"College ""{c}""\nCity", {cat},CS,{1000 * (c + 1) + 10 * (year - 2023)}'
        yield f'E{c},"College ""{c}""\nCity",{cat},ME,--'


def test_comedk_long(spark, tmp_path):
    for year in (2023, 2025):
        save(tmp_path / f"comedk{year}.csv", long_file(year))
    out = str(tmp_path / "clean")
    pipelines.ingest_comedk(spark, str(tmp_path), out)
    clean = readers.read_parquet(spark, out)
    assert clean.count() == 16
    assert {r.college_name for r in clean.collect()} == {f'College "{c}"\nCity' for c in range(4)}
    assert {r.category for r in clean.collect()} == {"GM", "KKR"}
    table, model = str(tmp_path / "features"), str(tmp_path / "model")
    pipelines.build_comedk_features(spark, out, table)
    assert readers.read_parquet(spark, table).columns == features.COMEDK_COLUMNS
    pipelines.train_ranks(
        spark, table, model, models.COMEDK_SPEC, [*features.COMEDK_SEAT, "year"], **QUICK
    )
    whole = pipelines.evaluate_ranks(spark, table, model, models.COMEDK_SPEC).first()
    assert whole.n_rows == 16 and whole.rmse >= 0
    asked = spark.createDataFrame([(1, "gm"), (10**6, "gm")], "user_rank INT, category STRING")
    got = pipelines.recommend_comedk(spark, asked, table, model, branch="cs").collect()
    assert [r.user_rank for r in got].count(1) >= 1
    assert all(r.tier == "Safe" for r in got if r.user_rank == 1)
    assert not [r for r in got if r.user_rank == 10**6]


def test_comedk_wide(spark, tmp_path):
    save(tmp_path / "comedk2023.csv", [
        "Code,Name,Cat,CS,ME", 'E1,"A\nB",gm,100,--', "E2,C,gm,0,", "E3,D,xx,5,6",
    ])
    save(tmp_path / "comedk2024.csv", ["Code,Name,Cat,EE", "E1,A B,GM,250.5"])
    out = str(tmp_path / "clean")
    pipelines.ingest_comedk_wide(spark, str(tmp_path), out)
    got = rows(readers.read_parquet(spark, out), "college_name", "course_name", "rank", "year")
    assert got == [("A B", "CS", 100.0, 2023), ("A B", "EE", 250.5, 2024)]
    table = str(tmp_path / "features")
    pipelines.build_comedk_simple(spark, out, table)
    assert rows(readers.read_parquet(spark, table), "closing_rank", "latest_recorded_year") == [
        (100.0, 2023), (250.5, 2024)
    ]


def test_no_file_at_all(spark, tmp_path):
    counts = pipelines.ingest_comedk(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert (counts.raw, counts.clean) == (0, 0)
    assert readers.read_parquet(spark, str(tmp_path / "out")).count() == 0


def test_header_check(spark, tmp_path):
    path = save(tmp_path / "x.csv", ["b,a", "1,2"])
    assert readers.read_csv(spark, path, "a INT, b INT").first() == (1, 2)
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, path, "a INT, b INT", check_header=True).collect()


def test_first_existing(spark, tmp_path):
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "no")])


def test_partitioned_write_keeps_every_row(spark, tmp_path):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k")
    )
    for spread in (1, 4):
        path = str(tmp_path / f"p{spread}")
        writers.write_parquet(df, path, ["k"], files_per_partition=spread)
        back = readers.read_partitioned(spark, path, "id BIGINT, k STRING")
        assert rows(back, "id", "k") == rows(df, "id", "k")


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_parquet(spark.range(6).withColumn("p", F.col("id") % 2), path, ["p"])
    flat = str(tmp_path / "flat")
    writers.write_parquet(spark.range(4), flat)
    catalog.register_tables(spark, "cutline_test", {"parted": path, "flat": flat})
    assert spark.table("cutline_test.parted").count() == 6
    assert spark.table("cutline_test.flat").count() == 4
    spark.sql("DROP DATABASE cutline_test CASCADE")


def test_materialise(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    assert rows(materialise(df)) == rows(df)


def test_high_cardinality_category(spark):
    df = spark.range(400).select(
        F.concat(F.lit("c"), F.col("id") % 40).alias("college"),
        F.lit("x").alias("kind"),
        F.lit(2020).alias("year"),
        ((F.col("id") % 40) * 100 + 50).cast("double").alias("closing_rank"),
    )
    spec = models.FeatureSpec(["college", "kind"], ["year"])
    model = models.train_regressor(df, spec, maxIter=8, maxDepth=4, stepSize=0.5)
    scored = models.score_ranks(model, df)
    corr = scored.stat.corr("closing_rank", "pred_closing_rank")
    assert corr > 0.9
    new = df.limit(1).withColumn("college", F.lit("new"))
    assert models.score_ranks(model, new).count() == 1
    assert models.score_ranks(models.dropping_unseen(model), new).count() == 0


def test_better_than_a_constant(spark):
    df = spark.range(600).select(
        F.concat(F.lit("c"), F.col("id") % 6).alias("institute"),
        F.lit("GM").alias("category"),
        (2018 + F.col("id") % 4).cast("int").alias("year"),
        ((F.col("id") % 6) * 1000 + 500 + F.col("id") % 7).cast("double").alias("closing_rank"),
    )
    model = models.train_regressor(df, models.NEET_SPEC, maxIter=10, maxDepth=3, stepSize=0.5)
    from cutline.operators.metrics import regression_report

    held = models.score_ranks(model, df)
    assert regression_report(held, "closing_rank", "pred_closing_rank").first().r2 > 0.8
    top = models.feature_importance(spark, model, 2).collect()
    assert top[0].feature == "institute__mean"
