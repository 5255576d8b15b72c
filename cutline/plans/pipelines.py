"""The four pipelines: raw files to clean table, feature table, model, recommendations.

Every step reads and writes tables under caller-given paths (any Hadoop file system).
Frames that several branches read are written once in between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators import cleaning, features, metrics, models, recommend
from cutline.operators import reshape, sampling, vocab
from cutline.session import materialise
from cutline.sources import readers, schemas, writers

JEE_PARTITIONS = ["year", "institute_type", "category"]
YEAR_PARTITIONS = ["year", "category"]
COMEDK_FILE = "comedk"  # fixed value: files are named comedk<year>.csv


@dataclass(frozen=True)
class IngestCounts:
    raw: int
    clean: int

    @property
    def dropped(self) -> int:
        return self.raw - self.clean


def write_counted(
    raw: DataFrame, clean_step, path: str, partition_by: list[str] | None = None
) -> IngestCounts:
    """Writes ``clean_step(raw)`` and counts both sides.

    The clean count comes from the written files' footers. Counters inside the writing
    job would be cheaper for the raw side, but repeat when a lost task is run again.
    """
    writers.write_parquet(clean_step(raw), path, partition_by)
    written = raw.sparkSession.read.parquet(path)
    return IngestCounts(raw.count(), written.count())


# ---- ingest ------------------------------------------------------------------------


def ingest_jee(spark: SparkSession, csv_path: str, out: str) -> IngestCounts:
    raw = readers.read_csv(spark, csv_path, schemas.JEE_RAW)
    return write_counted(raw, cleaning.clean_jee, out, JEE_PARTITIONS)


def ingest_neet(spark: SparkSession, csv_dir: str, out: str) -> IngestCounts:
    raw = readers.read_csv(spark, csv_dir, schemas.NEET_RAW, recursive=True)

    def clean(rows: DataFrame) -> DataFrame:
        return cleaning.clean_neet(readers.with_source_year(rows, csv_dir))

    return write_counted(raw, clean, out, YEAR_PARTITIONS)


def audit_neet(spark: SparkSession, csv_dir: str) -> DataFrame:
    """Rows read, dated, valid and dropped per file."""
    raw = readers.read_csv(spark, csv_dir, schemas.NEET_RAW, recursive=True)
    return cleaning.audit_files(raw, csv_dir, cleaning.valid_neet())


def ingest_kcet(spark: SparkSession, csv_path: str, out: str) -> IngestCounts:
    raw = readers.read_csv(spark, csv_path, schemas.KCET_RAW)
    return write_counted(raw, cleaning.clean_kcet, out, YEAR_PARTITIONS)


def ingest_comedk(
    spark: SparkSession, raw_dir: str, out: str, years: list[int] | None = None
) -> IngestCounts:
    """Long files ``comedk<year>.csv``: the years given, or all in the folder."""
    years = readers.years_in(spark, raw_dir, COMEDK_FILE) if years is None else years

    def load(year: int) -> DataFrame:
        rows = readers.read_csv_text(spark, f"{raw_dir}/comedk{year}.csv")
        return cleaning.shape_comedk_long(rows)

    raw = readers.read_years(spark, years, load, schemas.COMEDK_CLEAN)
    return write_counted(raw, cleaning.clean_comedk_long, out)


def ingest_comedk_wide(
    spark: SparkSession, raw_dir: str, out: str, years: list[int] | None = None
) -> IngestCounts:
    """Wide files: three id columns by position, then one column per course."""
    years = readers.years_in(spark, raw_dir, COMEDK_FILE) if years is None else years
    names = ["college_code", "college_name", "category"]

    def load(year: int) -> DataFrame:
        rows = readers.read_csv_text(spark, f"{raw_dir}/comedk{year}.csv")
        return reshape.unpivot_courses(rows, names=names)

    raw = readers.read_years(spark, years, load, schemas.COMEDK_CLEAN)
    return write_counted(raw, cleaning.clean_comedk_wide, out)


# ---- features ----------------------------------------------------------------------


def jee_feature_rows(clean: DataFrame, null_safe: bool = False) -> DataFrame:
    """Feature table; the rows per seat type are written once before they are ranked."""
    base = materialise(features.jee_base(clean, null_safe), "jee-base")
    return features.with_difficulty(base)


def build_jee_features(
    spark: SparkSession, clean_path: str, out_first: str, out_rest: str, marker: str = "IIT"
) -> None:
    """Feature rows of the marked institute type and of all others, in two tables."""
    rows = jee_feature_rows(readers.read_parquet(spark, clean_path))
    first = F.col("institute_type") == marker
    routes = {out_first: first, out_rest: F.col("institute_type") != marker}
    writers.write_split(rows, routes, ["category", "quota"])


def build_neet_features(spark: SparkSession, clean_path: str, out: str) -> None:
    rows = readers.read_parquet(spark, clean_path)
    writers.write_parquet(features.neet_features(rows), out)


def build_kcet_features(spark: SparkSession, clean_path: str, out: str) -> None:
    """Category codes such as ``1`` or ``02`` stay text: types are declared."""
    schema = (
        "college_id STRING, college_name STRING, course_name STRING, category STRING, "
        "rank DOUBLE, year INT, base_category STRING, quota STRING, region STRING"
    )
    rows = readers.read_partitioned(spark, clean_path, schema)
    writers.write_parquet(features.kcet_features(rows), out)


def comedk_feature_rows(clean: DataFrame, as_of: bool = False) -> DataFrame:
    yearly = materialise(features.comedk_yearly(features.comedk_valid(clean)), "yearly")
    return features.comedk_features(yearly, as_of)


def build_comedk_features(spark: SparkSession, clean_path: str, out: str) -> None:
    rows = readers.read_parquet(spark, clean_path)
    writers.write_parquet(comedk_feature_rows(rows), out)


def build_comedk_simple(spark: SparkSession, clean_path: str, out: str) -> None:
    rows = readers.read_parquet(spark, clean_path)
    writers.write_parquet(features.comedk_simple(rows), out)


# ---- training ----------------------------------------------------------------------


def train_jee(spark: SparkSession, features_path: str, model_path: str, **settings) -> DataFrame:
    """Trains on drawn ranks, stops early on the held-out part, returns its report."""
    rows = readers.read_parquet(spark, features_path)
    samples = materialise(sampling.sample_eligibility(rows, features.JEE_KEYS), "samples")
    keys = [*features.JEE_KEYS, "draw"]
    parts = materialise(
        # Another seed than that of the drawn ranks, or a row's part would follow from its rank.
        sampling.split_stratified(samples, "eligible", keys, seed=43).withColumn(
            "held_out", F.col("is_test") == 1
        ),
        "parts",
    )
    model = models.train_classifier(parts, validation="held_out", **settings)
    models.save_artifacts(model_path, model)
    held = materialise(models.score_eligibility(model, parts.filter("held_out")), "held")
    auc = metrics.exact_auc(held, "eligible", "eligibility_prob").select("auc").scalar()
    report = metrics.classification_report(held, "eligible", "eligibility_prob")
    return report.withColumn("auc", auc)


def train_ranks(
    spark: SparkSession,
    features_path: str,
    model_path: str,
    spec: models.FeatureSpec,
    keys: list[str],
    ranges: dict | None = None,
    trials: int = 15,
    folds: int = 3,
    in_ranks: bool = False,
    **settings,
) -> DataFrame:
    """Searches ``ranges`` by cross-validation if given, fits the best settings, returns the
    held-out report."""
    rows = readers.read_parquet(spark, features_path).dropna(
        subset=["closing_rank", *spec.categorical]
    )
    parts = materialise(sampling.split_by_hash(rows, keys), "parts")
    train = materialise(parts.filter("is_test = 0"), "train")
    if ranges:
        found = models.tune_regressor(
            train, spec, keys, ranges, trials, folds=folds, in_ranks=in_ranks
        )
        settings = {**settings, **models.best_trial(found).settings}
    model = models.train_regressor(train, spec, **settings)
    models.save_artifacts(model_path, model)
    held = models.score_ranks(model, parts.filter("is_test = 1"))
    return metrics.regression_report(held, "closing_rank", "pred_closing_rank")


def evaluate_ranks(
    spark: SparkSession, features_path: str, model_path: str, spec: models.FeatureSpec
) -> DataFrame:
    """Report of a saved model over a whole feature table."""
    rows = readers.read_parquet(spark, features_path).dropna(
        subset=["closing_rank", *spec.categorical]
    )
    model, _ = models.load_artifacts(spark, model_path)
    scored = models.score_ranks(model, rows.filter(F.col("closing_rank") > 0))
    return metrics.regression_report(scored, "closing_rank", "pred_closing_rank")


# ---- recommendation ----------------------------------------------------------------


def recommend_jee(
    spark: SparkSession, requests: DataFrame, segments: dict[str, tuple[str, str]]
) -> tuple[DataFrame, recommend.Answers]:
    """Outcome of each request, and the answers, from (features path, model path) per segment."""
    known = {
        name: (readers.read_parquet(spark, rows), models.load_artifacts(spark, model)[0])
        for name, (rows, model) in segments.items()
    }
    return recommend.jee_answers(requests, known)


def recommend_neet(
    spark: SparkSession,
    requests: DataFrame,
    features_path: str,
    model_path: str,
    year: int = 2026,
    limit: int | None = None,
) -> DataFrame:
    """Each distinct category is scored once; ranks only pick a run of its order."""
    seen = readers.read_parquet(spark, features_path).select("institute")
    known = materialise(vocab.build_vocabulary(seen, "institute", with_unknown=True), "vocab")
    model, _ = models.load_artifacts(spark, model_path)
    contexts = requests.select("category").distinct()
    grid = recommend.neet_candidates(contexts, known, year)
    scored = materialise(models.score_ranks(model, grid), "scored")
    return recommend.recommend_by_gap(
        requests, scored, ["category"], "candidate_rank", "pred_closing_rank",
        ["institute", "course"], recommend.NEET_RULE, limit,
    )


def recommend_kcet(
    spark: SparkSession,
    requests: DataFrame,
    features_path: str,
    model_path: str,
    year: int = 2026,
    limit: int | None = None,
) -> DataFrame:
    context = ["category", "base_category", "quota", "region"]
    seats = readers.read_parquet(spark, features_path).select("college_name", "course_name")
    seen = materialise(seats.distinct(), "seats")
    colleges = materialise(vocab.build_vocabulary(seen, "college_name"), "vocab")
    courses = materialise(vocab.build_vocabulary(seen, "course_name"), "vocab")
    model, _ = models.load_artifacts(spark, model_path)
    asked = requests.withColumns({c: F.upper(c) for c in context})
    grid = recommend.kcet_candidates(asked.select(*context), colleges, courses, year)
    scored = materialise(models.score_ranks(model, grid), "scored")
    return recommend.recommend_by_gap(
        asked, scored, context, "user_rank", "pred_closing_rank",
        ["college_name", "course_name"], recommend.KCET_RULE, limit,
    )


def recommend_comedk(
    spark: SparkSession,
    requests: DataFrame,
    features_path: str,
    model_path: str,
    year: int = 2026,
    branch: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Seat types with a history in the category; colleges new to the model are dropped."""
    rows = readers.read_parquet(spark, features_path)
    yearly = rows.select(*features.COMEDK_SEAT, "year", "closing_rank")
    history = features.history_stats(
        recommend.filter_branch(yearly, "course_name", branch), year
    )
    model, _ = models.load_artifacts(spark, model_path)
    strict = models.dropping_unseen(model)
    scored = materialise(models.score_ranks(strict, history), "scored")
    asked = requests.withColumn("category", F.upper("category"))
    return recommend.recommend_by_gap(
        asked, scored, ["category"], "user_rank", "pred_closing_rank",
        ["college_name", "course_name"], recommend.COMEDK_RULE, limit,
    )
