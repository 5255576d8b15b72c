"""Registered queries: each runs one operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutline.functions import ranks, text
from cutline.operators import (
    cleaning,
    encoding,
    features,
    metrics,
    models,
    profile,
    recommend,
    reshape,
    sampling,
    store,
    vocab,
)
from cutline.plans import pipelines
from cutline.plans.fixtures import table, view
from cutline.session import materialise, scratch_dir
from cutline.sources import catalog, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEAT_NAMES = {"institute": "college_name", "course": "course_name"}
SCORED_NAMES = ["institute", "course"]
EVAL_KEYS = ["l_orderkey", "l_linenumber"]
MARKER = "ASIA"  # the region that stands for the first segment
TARGET_YEAR = 2002


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


def counted(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))


# ---- scans and sinks ---------------------------------------------------------------


RANKED_SCHEMA = (
    "institute STRING, course STRING, category STRING, base_category STRING, "
    "quota STRING, region STRING, year INT, rank DOUBLE"
)


@query
def scan_csv_schema(spark, sf_dir):
    path = scratch_dir(spark, "csv-schema")
    writers.write_csv(view(spark, sf_dir, "fx_ranked"), path)
    return readers.read_csv(spark, path, RANKED_SCHEMA, check_header=True)


@query
def scan_csv_dir(spark, sf_dir):
    """One sub-directory of files per year, read as one table."""
    ranked = view(spark, sf_dir, "fx_ranked")
    path = scratch_dir(spark, "csv-dir")
    writers.write_csv(ranked.withColumn("part", F.col("year")), path, ["part"])
    rows = readers.read_csv(spark, path, RANKED_SCHEMA, recursive=True)
    return rows.groupBy("institute", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rank").alias("sum_rank")
    )


@query
def scan_csv_multiline(spark, sf_dir):
    path = scratch_dir(spark, "csv-multiline")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    writers.write_csv_text(docs, path)
    rows = readers.read_csv_text(spark, path)
    return rows.select(
        F.col("doc_id").try_cast("long").alias("doc_id"),
        "lang",
        "source",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("n_chars"),
    )


@query
def source_year(spark, sf_dir):
    """Year taken from the path of each file, not from its rows."""
    ranked = view(spark, sf_dir, "fx_ranked")
    path = scratch_dir(spark, "csv-year")
    writers.write_csv(ranked.withColumnRenamed("year", "part"), path, ["part"])
    schema = RANKED_SCHEMA.replace("year INT, ", "")
    rows = readers.read_csv(spark, path, schema, recursive=True)
    return counted(readers.with_source_year(rows, path), "year")


@query
def scan_parquet(spark, sf_dir):
    orders = readers.read_parquet(spark, f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query
def roundtrip_partitioned(spark, sf_dir):
    path = scratch_dir(spark, "partitioned")
    writers.write_parquet(view(spark, sf_dir, "fx_ranked"), path, ["year", "category"])
    rows = readers.read_partitioned(spark, path, RANKED_SCHEMA)
    return profile.partition_counts(rows, ["year", "category"])


@query
def split_segment(spark, sf_dir):
    path = scratch_dir(spark, "split")
    clean = cleaning.clean_jee(view(spark, sf_dir, "fx_allotment"))
    first = F.col("institute_type") == MARKER
    routes = {f"{path}/iit": first, f"{path}/nit": ~first}
    writers.write_split(clean, routes, ["category", "quota"])
    parts = [
        counted(readers.read_parquet(spark, f"{path}/{name}"), "category", "quota").withColumn(
            "segment", F.lit(name)
        )
        for name in ("iit", "nit")
    ]
    return reshape.union_all(parts).select("segment", "category", "quota", "n_rows")


@query
def catalog_register(spark, sf_dir):
    path = scratch_dir(spark, "catalog")
    writers.write_parquet(view(spark, sf_dir, "fx_ranked"), path, ["year"])
    name = "clean_" + path.rsplit("-", 1)[-1]
    catalog.register_tables(spark, "cutline_db", {name: path})
    return counted(spark.table(f"cutline_db.{name}"), "year")


@query
def csv_sink(spark, sf_dir):
    """Top rows per category written as CSV with their position, then read back."""
    top = recommend.top_overall(view(spark, sf_dir, "fx_scored"), ["category"], SCORED_NAMES)
    path = scratch_dir(spark, "csv-sink")
    cols = ["category", "pos", "institute", "course", "eligibility_prob"]
    writers.write_csv(top.select(*cols), path)
    schema = "category STRING, pos BIGINT, institute STRING, course STRING, eligibility_prob DOUBLE"
    return readers.read_csv(spark, path, schema)


# ---- cleaning ----------------------------------------------------------------------


@query
def clean_required(spark, sf_dir):
    raw = view(spark, sf_dir, "fx_allotment")
    return cleaning.require(raw, [*cleaning.JEE_REQUIRED, "degree_short"])


@query
def clean_rank_sanity(spark, sf_dir):
    return cleaning.sane_ranks(view(spark, sf_dir, "fx_allotment"))


@query
def filter_rounds(spark, sf_dir):
    return cleaning.final_rounds(view(spark, sf_dir, "fx_allotment"))


@query
def filter_category(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_ranked")
    return rows.filter(F.col("category").isin("BUILDING", "MACHINERY"))


@query
def canon_pool(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_allotment")
    return counted(rows.withColumn("canonical", ranks.canonical_pool("pool")), "pool", "canonical")


SEGMENT_ALIASES = {"BUILDING": "GEN-EWS", "MACHINERY": "GEN"}


@query
def canon_category(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_allotment")
    named = ranks.canonical_category(text.upper_trim("category"), SEGMENT_ALIASES)
    return counted(rows.withColumn("canonical", named), "category", "canonical")


@query
def normalise_strings(spark, sf_dir):
    rows = cleaning.normalise_allotment(view(spark, sf_dir, "fx_allotment"))
    return counted(rows, "quota", "category", "institute_type", "institute_short", "program_name")


@query
def strip_links(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_allotment")
    return counted(
        rows.withColumn("degree", text.strip_links("degree_short")), "degree_short", "degree"
    )


@query
def clean_newlines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = text.one_line("text")
    return docs.select(
        "doc_id", F.md5(line).alias("line_md5"), F.length(line).cast("long").alias("n_line")
    )


@query
def coerce_numeric(spark, sf_dir):
    wide = view(spark, sf_dir, "fx_wide")
    return wide.select(
        "institute",
        "category",
        "year",
        ranks.as_number("c_small").alias("small_rank"),
        ranks.as_number("c_economy").alias("economy_rank"),
    )


@query
def project_rename(spark, sf_dir):
    names = {"institute": "college_name", "course": "course_name", "rank": "cutoff_rank"}
    renamed = view(spark, sf_dir, "fx_ranked").withColumnsRenamed(names)
    return renamed.select(
        "college_name", "course_name", "category", "year", "cutoff_rank",
        F.lit("ranked").alias("source"),
    )


@query
def infer_segment(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_ranked")
    return counted(
        rows.withColumn("segment", ranks.infer_segment("institute", "1")), "institute", "segment"
    )


@query
def ingest_audit(spark, sf_dir):
    return cleaning.audit(view(spark, sf_dir, "fx_allotment"))


@query
def ingest_audit_files(spark, sf_dir):
    """Counts per folder of files; one folder has no year in its name."""
    ranked = view(spark, sf_dir, "fx_ranked")
    path = scratch_dir(spark, "csv-audit")
    part = F.when(F.col("quota") == "P", "undated").otherwise(F.col("year").cast("string"))
    writers.write_csv(ranked.withColumn("part", part), path, ["part"])
    raw = readers.read_csv(spark, path, RANKED_SCHEMA, recursive=True)
    folder = F.substring_index(readers.below(path), "/", 1)  # Spark's file names hold digits
    files = cleaning.audit_files(raw, path, F.col("rank") > 20000, readers.year_of(folder))
    sums = [F.sum(c).alias(c) for c in files.columns if c != "file"]
    return files.groupBy(F.substring_index("file", "/", 1).alias("folder")).agg(*sums)


@query
def scan_first_existing(spark, sf_dir):
    """The first of several places that exists."""
    path = scratch_dir(spark, "place")
    writers.write_parquet(view(spark, sf_dir, "fx_ranked"), f"{path}/second")
    found = readers.first_existing(spark, [f"{path}/first", f"{path}/second", f"{path}/third"])
    return counted(readers.read_parquet(spark, found), "year")


@query
def scan_uri(spark, sf_dir):
    """Written and read by a full URI with scheme."""
    uri = readers.qualified(spark, scratch_dir(spark, "uri"))
    writers.write_parquet(view(spark, sf_dir, "fx_ranked"), uri, ["year"])
    scheme = F.lit(int("://" in uri or uri.startswith("file:"))).alias("has_scheme")
    return counted(readers.read_parquet(spark, uri), "category").select("*", scheme)


@query
def scan_missing_year(spark, sf_dir):
    """Years with and without files; no file at all gives no rows, not an error."""
    path = scratch_dir(spark, "some-years")
    ranked = view(spark, sf_dir, "fx_ranked").withColumnRenamed("year", "part")
    writers.write_parquet(ranked.select("institute", "rank", "part"), path, ["part"])

    def load(year):
        return spark.read.parquet(f"{path}/part={year}")

    asked = [[1900], [1900, 1996], [1995, 1996]]
    parts = [
        readers.read_years(spark, years, load, "institute STRING, rank DOUBLE, year INT").agg(
            F.lit(k).alias("asked"), F.count(F.lit(1)).alias("n_rows"), F.max("rank").alias("highest")
        )
        for k, years in enumerate(asked)
    ]
    return reshape.union_all(parts)


@query
def preview_rows(spark, sf_dir):
    """A preview has as many rows as asked for, and all of them are in the table."""
    ranked = view(spark, sf_dir, "fx_ranked")
    some = materialise(profile.preview(ranked, ["institute", "year", "rank"], 5), "preview")
    known = some.join(ranked, ["institute", "year", "rank"], "left_semi")
    return some.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_known", known.agg(F.count(F.lit(1))).scalar()
    )


@query
def align_columns(spark, sf_dir):
    """Columns that a model wants: those present in its order, the missing ones as 0."""
    ranked = view(spark, sf_dir, "fx_ranked")
    some = reshape.keep_present(ranked, ["rank", "spread", "institute", "year"])
    return reshape.add_missing(some, ["institute", "year", "rank", "spread", "trend"])


@query
def partition_counts(spark, sf_dir):
    clean = cleaning.clean_jee(view(spark, sf_dir, "fx_allotment"))
    return profile.partition_counts(clean, ["year", "institute_type", "category"])


# ---- JEE features ------------------------------------------------------------------


def _jee_clean(spark, sf_dir):
    return cleaning.clean_jee(view(spark, sf_dir, "fx_allotment"))


def _per_year(spark, sf_dir):
    return features.jee_per_year(_jee_clean(spark, sf_dir))


@query
def jee_per_year(spark, sf_dir):
    return _per_year(spark, sf_dir)


@query
def jee_multi_year(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir))
    rows = rows.drop("yoy_rank_change", "trend_direction")
    return rounded(rows, "closing_rank_avg", "closing_rank_std", "rank_spread_avg")


@query
def jee_latest_prev(spark, sf_dir):
    rows = features.jee_latest_prev(_per_year(spark, sf_dir)).filter("years_back = 1")
    return rows.select(
        *features.JEE_KEYS, "year", F.col("closing_rank_year").alias("cr_latest"),
        F.col("cr_before").alias("cr_prev"),
    )


@query
def jee_trend(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir))
    return rows.select(*features.JEE_KEYS, "yoy_rank_change", "trend_direction")


@query
def jee_rank_pressure(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir))
    pressure = ranks.rank_pressure("closing_rank_avg", "opening_rank_min")
    return rows.select(*features.JEE_KEYS, pressure.alias("rank_pressure"))


@query
def jee_difficulty(spark, sf_dir):
    base = materialise(features.jee_multi_year(_per_year(spark, sf_dir)), "jee-base")
    return features.with_difficulty(base).select(*features.JEE_KEYS, "difficulty_pct")


def _jee_features(spark, sf_dir):
    return pipelines.jee_feature_rows(_jee_clean(spark, sf_dir))


@query
def jee_features(spark, sf_dir):
    return rounded(
        _jee_features(spark, sf_dir), "closing_rank_avg", "closing_rank_std", "rank_spread_avg"
    )


@query
def legacy_features(spark, sf_dir):
    rows = features.legacy_features(_jee_clean(spark, sf_dir), "PROMO|SMALL")
    return rounded(rows, "round_norm")


# ---- other feature tables ----------------------------------------------------------


def _valid(spark, sf_dir):
    return features.comedk_valid(
        view(spark, sf_dir, "fx_ranked").withColumnsRenamed(SEAT_NAMES)
    )


def _yearly(spark, sf_dir):
    return features.comedk_yearly(_valid(spark, sf_dir))


def _yearly_table(spark, sf_dir):
    """Written once where several branches read it, so the raw rows are scanned once."""
    return materialise(_yearly(spark, sf_dir), "yearly")


@query
def neet_features(spark, sf_dir):
    rows = features.neet_features(view(spark, sf_dir, "fx_ranked"))
    return rounded(rows, "closing_rank_avg", "closing_rank_std")


@query
def kcet_features(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_ranked").withColumnsRenamed(SEAT_NAMES)
    return rounded(features.kcet_features(rows), "closing_rank_avg", "closing_rank_std")


@query
def comedk_simple(spark, sf_dir):
    rows = features.comedk_simple(_valid(spark, sf_dir))
    return rounded(rows, "closing_rank_avg", "closing_rank_std")


@query
def comedk_yearly(spark, sf_dir):
    return _yearly(spark, sf_dir)


@query
def comedk_trend(spark, sf_dir):
    rows = features.comedk_trend(_yearly(spark, sf_dir))
    return rounded(rows, "closing_rank_mean", "closing_rank_std")


@query
def comedk_lag(spark, sf_dir):
    return rounded(
        features.with_previous_year(_yearly(spark, sf_dir)), "prev_year_closing_rank"
    )


@query
def comedk_college_avg(spark, sf_dir):
    return rounded(features.college_average(_yearly_table(spark, sf_dir)), "college_avg_rank")


@query
def comedk_category_avg(spark, sf_dir):
    return rounded(features.category_average(_yearly(spark, sf_dir)), "category_avg_rank")


COMEDK_ROUNDED = [
    "prev_year_closing_rank", "closing_rank_mean", "closing_rank_std", "college_avg_rank",
    "category_avg_rank",
]


@query
def comedk_features(spark, sf_dir):
    return rounded(features.comedk_features(_yearly_table(spark, sf_dir)), *COMEDK_ROUNDED)


@query
def comedk_features_as_of(spark, sf_dir):
    """The variant whose trend covers earlier years only."""
    rows = features.comedk_features(_yearly_table(spark, sf_dir), as_of=True)
    return rounded(rows, *COMEDK_ROUNDED)


@query
def history_list(spark, sf_dir):
    lists = features.history_lists(_yearly(spark, sf_dir))
    words = F.transform("history", lambda x: x.cast("long").cast("string"))
    return lists.select(*features.COMEDK_SEAT, F.array_join(words, ",").alias("history"))


@query
def history_stats(spark, sf_dir):
    rows = features.history_stats(_yearly(spark, sf_dir), TARGET_YEAR)
    return rounded(
        rows, "closing_rank_mean", "closing_rank_std", "college_avg_rank", "category_avg_rank"
    )


# ---- fills, profiles, vocabularies -------------------------------------------------


@query
def fill_constant(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir)).select(
        *features.JEE_KEYS, "yoy_rank_change", "trend_direction"
    )
    fills = {"yoy_rank_change": 0, "trend_direction": "UNKNOWN", "degree_short": "UNKNOWN"}
    return profile.fill_constant(rows, fills)


@query
def fill_median(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir)).select(
        *features.JEE_KEYS, "yoy_rank_change", "closing_rank_std"
    )
    filled = profile.fill_median(
        materialise(rows, "trend"), ["yoy_rank_change", "closing_rank_std"]
    )
    return rounded(filled, "closing_rank_std")


@query
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(
        view(spark, sf_dir, "fx_ranked"), ["year", "institute", "course", "category"]
    )


@query
def profile_target(spark, sf_dir):
    return rounded(profile.target_range(_yearly(spark, sf_dir), "closing_rank"), "mean")


@query
def profile_nulls(spark, sf_dir):
    return profile.null_counts(_jee_features(spark, sf_dir))


@query
def vocab_build(spark, sf_dir):
    names = view(spark, sf_dir, "fx_ranked").select("institute").distinct()
    return vocab.build_vocabulary(materialise(names, "names"), "institute")


def _known_institutes(spark, sf_dir, every=False):
    """Vocabulary of all institutes, or of all regions but one, so that some are unseen."""
    seats = view(spark, sf_dir, "fx_ranked")
    seats = seats if every else seats.filter(F.col("region") != MARKER)
    seen = materialise(seats.select("institute").distinct(), "names")
    return materialise(vocab.build_vocabulary(seen, "institute", with_unknown=True), "vocab")


@query
def vocab_unknown(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_ranked")
    known = _known_institutes(spark, sf_dir)
    coded = vocab.lookup_or_unknown(rows, "institute", known, "institute_id")
    return counted(coded, "institute", "institute_id", "year")


@query
def vocab_semi(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_ranked")
    known = _known_institutes(spark, sf_dir)
    return counted(vocab.keep_known(rows, "institute", known), "institute", "year")


# ---- reshaping ---------------------------------------------------------------------


@query
def unpivot_courses(spark, sf_dir):
    return reshape.unpivot_courses(view(spark, sf_dir, "fx_wide"))


@query
def comedk_wide(spark, sf_dir):
    """Wide file: unpivot, clean, simple features (the year stands for the code column)."""
    wide = view(spark, sf_dir, "fx_wide")
    ids = [F.col("year").cast("string").alias("code"), "institute", "category"]
    courses = [c for c in wide.columns if c.startswith("c_")]
    long = reshape.unpivot_courses(
        wide.select(*ids, *courses), names=["college_code", "college_name", "category"]
    )
    rows = long.withColumn("year", F.col("college_code").cast("int"))
    clean = cleaning.clean_comedk_wide(rows, ["BUILDING", "MACHINERY"])
    return rounded(features.comedk_simple(clean), "closing_rank_avg", "closing_rank_std")


@query
def union_years(spark, sf_dir):
    """One file set per year, columns in different orders; years without files are skipped."""
    path = scratch_dir(spark, "years")
    ranked = view(spark, sf_dir, "fx_ranked").withColumnRenamed("year", "part")
    rows = ranked.select("institute", "course", "category", "rank", "part")
    writers.write_parquet(rows, path, ["part"])

    def one_year(year):
        rows = spark.read.parquet(f"{path}/part={year}")
        return rows if year % 2 else rows.select(*reversed(rows.columns))

    empty = "institute STRING, course STRING, category STRING, rank DOUBLE, year INT"
    years = spark.read.parquet(path).select("part").distinct().collect()  # from directory names
    return readers.read_years(spark, sorted(r.part for r in years), one_year, empty)


@query
def dedup_latest(spark, sf_dir):
    return reshape.keep_highest(
        view(spark, sf_dir, "fx_ranked"), ["institute", "course", "category", "year"], "rank"
    )


# ---- sampling ----------------------------------------------------------------------


@query
def sample_pos_neg(spark, sf_dir):
    rows = features.jee_multi_year(_per_year(spark, sf_dir))
    samples = sampling.sample_eligibility(rows, features.JEE_KEYS)
    return samples.select(*features.JEE_KEYS, "draw", "student_rank", "eligible")


@query
def split_hash(spark, sf_dir):
    rows = sampling.split_by_hash(view(spark, sf_dir, "fx_eval"), EVAL_KEYS)
    return rows.select(*EVAL_KEYS, "is_test")


@query
def split_stratified(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_eval").select(*EVAL_KEYS, "label")
    return sampling.split_stratified(rows, "label", EVAL_KEYS)


@query
def split_stratified_many(spark, sf_dir):
    """Stratified by supplier: labels of any number and kind, NULL among them."""
    supplier = F.expr("nullif(l_suppkey, 1)").alias("supplier")
    rows = table(spark, sf_dir, "lineitem").select(*EVAL_KEYS, supplier)
    return sampling.split_stratified(rows, "supplier", EVAL_KEYS)


@query
def kfold_assign(spark, sf_dir):
    rows = sampling.assign_folds(view(spark, sf_dir, "fx_eval"), EVAL_KEYS, 3)
    return rows.select(*EVAL_KEYS, "fold")


@query
def class_weights(spark, sf_dir):
    return rounded(sampling.class_weights(view(spark, sf_dir, "fx_eval"), "label"), "weight")


@query
def label_counts(spark, sf_dir):
    return sampling.label_counts(view(spark, sf_dir, "fx_eval"), "label")


@query
def log_target(spark, sf_dir):
    rows = _yearly(spark, sf_dir)
    logged = rows.withColumn("log_rank", ranks.log_rank("closing_rank"))
    back = ranks.whole_rank(ranks.unlog_rank("log_rank") + F.lit(0.5)).alias("back")
    shown = F.round("log_rank", 4).alias("log_rank")
    return logged.select(*features.COMEDK_SEAT, "year", shown, back)


# ---- metrics -----------------------------------------------------------------------


@query
def eval_regression(spark, sf_dir):
    report = metrics.regression_report(view(spark, sf_dir, "fx_eval"), "y_true", "y_pred")
    return rounded(report, *[c for c in report.columns if c != "n_rows"])


@query
def eval_auc(spark, sf_dir):
    report = metrics.exact_auc(view(spark, sf_dir, "fx_eval"), "label", "score")
    return report.withColumn("auc", F.round("auc", 8))


@query
def eval_classification(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_eval")
    report = metrics.classification_report(rows, "label", "score", 50000)
    return rounded(report, "precision", "recall", "f1")


# ---- recommendation ----------------------------------------------------------------

JEE_REQUEST = ["user_rank", "exam_type", "category", "quota", "pool"]


def _requests(spark, sf_dir):
    return view(spark, sf_dir, "fx_requests")


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "fx_scored")


def _catalogue(spark, sf_dir):
    """The scored programmes as a table, as a scoring job leaves them."""
    return materialise(_scored(spark, sf_dir), "scored")


@query
def route_segment(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    return rows.select("request_id", ranks.route_segment("exam_type").alias("segment"))


@query
def request_dedup(spark, sf_dir):
    return recommend.distinct_requests(_requests(spark, sf_dir), "jee", JEE_REQUEST)


def _offered(spark, sf_dir):
    return features.jee_multi_year(_per_year(spark, sf_dir)).select(
        *features.JEE_KEYS, "closing_rank_max", "opening_rank_min"
    )


@query
def jee_candidate_match(spark, sf_dir):
    """Every programme of its cohort, for every different request."""
    matched = recommend.jee_matches(_requests(spark, sf_dir), _offered(spark, sf_dir), JEE_REQUEST, MARKER)
    return matched.select(
        "request_key", "institute_type", "institute_short", "program_name", "degree_short",
        "closing_rank_max", "opening_rank_min",
    )


@query
def jee_candidates(spark, sf_dir):
    """Programmes of every cohort that was asked for."""
    matched = recommend.jee_candidates(_requests(spark, sf_dir), _offered(spark, sf_dir), MARKER)
    return matched.select(
        *recommend.COHORT, "institute_short", "program_name", "degree_short",
        "closing_rank_max", "opening_rank_min",
    )


ASKED = ["category", "quota", "pool"]


@query
def request_answers(spark, sf_dir):
    """Requests in two batches; answers are issued once, kept, and reused for an hour."""
    asks = view(spark, sf_dir, "fx_asks").withColumn("request_key", text.request_key("jee", *ASKED))
    asks = materialise(asks, "asks")
    best = recommend.top_overall(_scored(spark, sf_dir), ["category"], SCORED_NAMES, limit=3)

    def answer(wanted):
        return wanted.select("request_key", "category").join(best, "category")

    path, served = scratch_dir(spark, "store"), []
    later = F.col("asked_at") >= F.lit("2024-01-16").cast("timestamp")
    for batch in (asks.filter(~later), asks.filter(later)):
        served.append(materialise(store.serve(batch, path, answer), "served"))
    kept = store.read_store(spark, path)
    if kept is None:  # no request at all
        kept = best.select(F.lit("").alias("request_key"), F.lit(0).alias("issued_at"), "pos", "institute")
    kept = kept.groupBy("request_key", "issued_at").agg(
        F.count("pos").alias("n_rows"), F.max_by("institute", -F.col("pos")).alias("first_institute")
    )
    rows = reshape.union_all(served).join(kept, ["request_key", "issued_at"])
    return rows.select("ask_id", "issued_at", "source", "n_rows", "first_institute")


@query
def branch_filter(spark, sf_dir):
    return recommend.filter_branch(_yearly(spark, sf_dir), "course_name", "pro")


KCET_CONTEXT = ["category", "base_category", "quota", "region"]


def _kcet_grid(spark, sf_dir):
    """All four attributes of the requests; vocabularies come from one pass over the rows."""
    seats = view(spark, sf_dir, "fx_ranked").select("institute", "course").distinct()
    seen = materialise(seats, "seats")
    contexts = _requests(spark, sf_dir).select(*KCET_CONTEXT)
    colleges = materialise(vocab.build_vocabulary(seen, "institute"), "vocab")
    courses = materialise(vocab.build_vocabulary(seen, "course"), "vocab")
    return recommend.kcet_candidates(contexts, colleges, courses, TARGET_YEAR)


@query
def kcet_grid(spark, sf_dir):
    return _kcet_grid(spark, sf_dir)


@query
def neet_candidates(spark, sf_dir):
    contexts = _requests(spark, sf_dir).select("category").distinct()
    known = _known_institutes(spark, sf_dir, every=True)
    return recommend.neet_candidates(contexts, known, TARGET_YEAR)


@query
def tier_probability(spark, sf_dir):
    rows = recommend.with_probability_tier(_scored(spark, sf_dir))
    return rows.select("institute", "course", "category", "eligibility_prob", "tier")


def _answers(spark, sf_dir, rule):
    return recommend.interval_answers(
        _requests(spark, sf_dir), _scored(spark, sf_dir), ["category"], "user_rank",
        "pred_closing_rank", SCORED_NAMES, rule,
    )


def _published(spark, sf_dir, rule):
    answers = _answers(spark, sf_dir, rule)
    return recommend.published(answers, SCORED_NAMES, "pred_closing_rank")


def _page(spark, sf_dir, rule, number, size):
    rows = _answers(spark, sf_dir, rule).page(number, size)
    return rows.withColumn("predicted_cutoff", ranks.whole_rank("pred_closing_rank")).drop(
        "pred_closing_rank"
    )


def _every(spark, sf_dir, rule):
    rows = _answers(spark, sf_dir, rule).every()
    return rows.withColumn("predicted_cutoff", ranks.whole_rank("pred_closing_rank")).drop(
        "pred_closing_rank"
    )


@query
def tier_neet(spark, sf_dir):
    """Complete answers: every programme of every tier of every request."""
    return _every(spark, sf_dir, recommend.NEET_RULE).drop("pos")


@query
def tier_kcet(spark, sf_dir):
    return _every(spark, sf_dir, recommend.KCET_RULE).drop("pos")


@query
def tier_comedk(spark, sf_dir):
    return _every(spark, sf_dir, recommend.COMEDK_RULE).drop("pos")


@query
def tier_neet_intervals(spark, sf_dir):
    """Complete answers in short form: an interval per tier, and the catalogue in its order."""
    return _published(spark, sf_dir, recommend.NEET_RULE)


@query
def tier_kcet_intervals(spark, sf_dir):
    return _published(spark, sf_dir, recommend.KCET_RULE)


@query
def tier_comedk_intervals(spark, sf_dir):
    return _published(spark, sf_dir, recommend.COMEDK_RULE)


def _ends(spark, sf_dir, rule):
    """Both ends of every tier's complete order, fetched by place."""
    answers = _answers(spark, sf_dir, rule)
    runs = answers.intervals()
    for end in ("first", "last"):
        names = {c: f"{end}_{c}" for c in SCORED_NAMES}
        rows = answers.placed.withColumn(
            f"{end}_cutoff", ranks.whole_rank("pred_closing_rank")
        ).drop("pred_closing_rank").withColumnsRenamed({**names, "place": end})
        runs = runs.join(rows, ["category", end])
    return runs.drop("first", "last")


@query
def tier_order(spark, sf_dir):
    """Complete tiers, highest cutoff first: every programme with its position."""
    return _every(spark, sf_dir, recommend.NEET_RULE)


@query
def tier_order_asc(spark, sf_dir):
    """Complete tiers, lowest cutoff first: every programme with its position."""
    return _every(spark, sf_dir, recommend.COMEDK_RULE)


@query
def tier_order_ends(spark, sf_dir):
    """Complete tiers, highest cutoff first: size, first and last programme."""
    return _ends(spark, sf_dir, recommend.NEET_RULE)


@query
def tier_order_asc_ends(spark, sf_dir):
    """Complete tiers, lowest cutoff first: size, first and last programme."""
    return _ends(spark, sf_dir, recommend.COMEDK_RULE)


@query
def tier_page(spark, sf_dir):
    """The third page of 20 of every tier."""
    return _page(spark, sf_dir, recommend.KCET_RULE, 2, 20)


@query
def tier_order_probability(spark, sf_dir):
    """Complete probability tiers per category, highest probability first."""
    tiered = recommend.with_probability_tier(_catalogue(spark, sf_dir))
    placed = recommend.order_tiers(tiered, ["category"], SCORED_NAMES)
    return placed.select("category", "tier", "pos", *SCORED_NAMES, "eligibility_prob")


@query
def tier_topk_desc(spark, sf_dir):
    return _page(spark, sf_dir, recommend.KCET_RULE, 0, recommend.TOP_PER_TIER)


@query
def tier_topk_asc(spark, sf_dir):
    return _page(spark, sf_dir, recommend.COMEDK_RULE, 0, recommend.TOP_PER_TIER)


@query
def threshold_topn(spark, sf_dir):
    rows = recommend.top_overall(_scored(spark, sf_dir), ["category"], SCORED_NAMES)
    return rows.select(
        "category", F.col("pos").cast("long").alias("pos"), *SCORED_NAMES, "eligibility_prob"
    )


@query
def request_summary(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    bounds = _answers(spark, sf_dir, recommend.NEET_RULE).bounds
    rows = recommend.request_summary(requests, bounds, ["category"], "user_rank")
    return rows.select("request_id", "n_safe", "n_likely", "has_result")


@query
def nested_response(spark, sf_dir):
    """Top 15 per tier as arrays, shown as text for the check."""
    top = _page(spark, sf_dir, recommend.NEET_RULE, 0, recommend.TOP_PER_TIER)
    nested = recommend.nested_response(
        top, ["category", "user_rank"], [*SCORED_NAMES, "predicted_cutoff"]
    )

    def words(entry):
        cutoff = entry["predicted_cutoff"].cast("string")
        return F.concat_ws("/", entry["institute"], entry["course"], cutoff)

    def shown(col):
        return F.array_join(F.transform(col, words), ",").alias(col)

    return nested.select("category", "user_rank", shown("safe"), shown("likely"))


@query
def response_pages(spark, sf_dir):
    """Complete nested response as JSON pages that all requests share, written and parsed back.

    A tier of a request is the entries between its first and last place (``tier_neet_intervals``).
    """
    placed = _answers(spark, sf_dir, recommend.NEET_RULE).placed
    rows = placed.withColumn("predicted_cutoff", ranks.whole_rank("pred_closing_rank"))
    fields = [*SCORED_NAMES, "predicted_cutoff"]
    pages = recommend.response_pages(rows, ["category"], "place", fields, 100)
    path = scratch_dir(spark, "pages")
    writers.write_parquet(pages, path, ["category"])
    entry = "place BIGINT, institute STRING, course STRING, predicted_cutoff BIGINT"
    return recommend.read_pages(spark.read.parquet(path), ["category", "page"], entry)


# ---- models ------------------------------------------------------------------------
# Scores themselves cannot be stated in SQL: these queries give row and key sets, counts and
# properties that must hold.

BOOSTED = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3}


def _flag(cond):
    return F.coalesce(cond, F.lit(False)).cast("int")


def _neet_rows(spark, sf_dir):
    rows = features.neet_features(view(spark, sf_dir, "fx_ranked"))
    return materialise(rows, "neet")


@query
def target_means(spark, sf_dir):
    """Mean log ranks of category values, per fold over the rows of the other folds."""
    dealt = sampling.assign_folds(_neet_rows(spark, sf_dir), features.NEET_KEYS, 3)
    rows = models.with_log_label(models.prepare(dealt, models.NEET_SPEC), "closing_rank")
    sums = materialise(encoding.fold_sums(rows, models.NEET_CATEGORICAL, "label"), "sums")
    means = encoding.target_means(sums, [0, 1, 2])
    return means.withColumn("mean", F.round("mean", 6))


@query
def train_regressor(spark, sf_dir):
    """Held-out rows, how many got a rank, and whether the report covers them all."""
    rows = sampling.split_by_hash(_neet_rows(spark, sf_dir), features.NEET_KEYS)
    train = materialise(rows.filter("is_test = 0"), "train")
    model = models.train_regressor(train, models.NEET_SPEC, **BOOSTED)
    held = models.score_ranks(model, rows.filter("is_test = 1"))
    held = materialise(held, "held")
    report = metrics.regression_report(held, "closing_rank", "pred_closing_rank")
    ranked = held.agg(F.count_if(F.col("pred_closing_rank") > 0)).scalar()
    told = _flag(F.col("rmse") >= F.col("mae")).alias("reported")
    return report.select("n_rows", ranked.alias("n_ranked"), told)


def _jee_samples(spark, sf_dir):
    rows = materialise(_jee_features(spark, sf_dir), "jee")
    samples = sampling.sample_eligibility(rows, features.JEE_KEYS)
    split = sampling.split_by_hash(samples, [*features.JEE_KEYS, "draw"], seed=43)
    flagged = split.withColumn("held_out", F.col("is_test") == 1)
    return rows, materialise(flagged, "samples")


def _segments(spark, sf_dir):
    """Features and model of each segment."""
    rows, samples = _jee_samples(spark, sf_dir)
    known = {}
    for name, own in (("IIT", F.col("institute_type") == MARKER), ("NIT", F.col("institute_type") != MARKER)):
        part = materialise(samples.filter(own), "segment")
        known[name] = rows.filter(own), models.train_classifier(part, validation="held_out", **BOOSTED)
    return known


@query
def train_classifier(spark, sf_dir):
    """Held-out rows of both classes, and whether the scores order them better than chance."""
    _, samples = _jee_samples(spark, sf_dir)
    model = models.train_classifier(samples, validation="held_out", **BOOSTED)
    held = models.score_eligibility(model, samples.filter("held_out"))
    report = metrics.exact_auc(held, "eligible", "eligibility_prob")
    better = _flag(F.col("auc") > 0.6).alias("beats_chance")
    return report.select("n_positive", "n_negative", better)


@query
def score_classifier(spark, sf_dir):
    """Every programme of every cohort asked for, scored by its segment's model for all ranks."""
    asked, parts = _requests(spark, sf_dir), []
    for name, (rows, model) in _segments(spark, sf_dir).items():
        offered = recommend.jee_candidates(asked, rows, MARKER).filter(F.col("segment") == name)
        parts.append(recommend.score_bands(model, offered))
    keys = [*recommend.COHORT, *recommend.JEE_NAMES]
    prob = F.col("eligibility_prob")
    return reshape.union_all(parts).groupBy(*keys).agg(
        _flag((F.min(prob) >= 0) & (F.max(prob) <= 1)).alias("in_range"),
        _flag(F.count(prob) == F.max("band") + 1).alias("all_bands"),
    )


@query
def jee_answers(spark, sf_dir):
    """Both segments in one batch: each request's programmes, and whether its answer fits them."""
    known = _segments(spark, sf_dir)
    outcomes, answers = recommend.jee_answers(_requests(spark, sf_dir), known, MARKER)
    offered = [
        recommend.jee_candidates(_requests(spark, sf_dir), rows, MARKER).filter(F.col("segment") == name)
        for name, (rows, _) in known.items()
    ]
    sizes = counted(reshape.union_all(offered), *recommend.COHORT)
    told = outcomes.join(sizes, recommend.COHORT, "left").fillna({"n_rows": 0})
    # The intervals say the same as the outcome.
    runs = answers.intervals().groupBy(*answers.group, answers.rank).agg(F.sum("n_rows").alias("listed"))
    told = told.join(runs, [*answers.group, answers.rank], "left").fillna({"listed": 0})
    found = F.col("n_safe") + F.col("n_likely")
    return told.select(
        "request_id", "segment", F.col("n_rows").alias("n_programmes"),
        _flag(found <= F.col("n_rows")).alias("within"),
        _flag(F.col("listed") == found).alias("listed"),
        _flag(F.col("has_result") == _flag(found > 0)).alias("told"),
    )


@query
def score_grid(spark, sf_dir):
    """Model trained on the feature table, every cell scored for the target year and answered from
    as intervals: cells per request, and whether its tiers fit them."""
    rows = features.kcet_features(view(spark, sf_dir, "fx_ranked").withColumnsRenamed(SEAT_NAMES))
    model = models.train_regressor(materialise(rows, "kcet"), models.KCET_SPEC, **BOOSTED)
    scored = materialise(models.score_ranks(model, _kcet_grid(spark, sf_dir)), "scored")
    requests = _requests(spark, sf_dir).withColumns({c: F.upper(c) for c in KCET_CONTEXT})
    answers = recommend.interval_answers(
        requests, scored, KCET_CONTEXT, "user_rank", "pred_closing_rank",
        ["college_name", "course_name"], recommend.KCET_RULE,
    )
    told = recommend.request_summary(requests, answers.bounds, KCET_CONTEXT, "user_rank")
    cells = scored.groupBy(*KCET_CONTEXT).agg(
        F.count("pred_closing_rank").alias("n_cells"), F.min("pred_closing_rank").alias("lowest")
    )
    fits = (F.col("n_safe") + F.col("n_likely") <= F.col("n_cells")) & (F.col("lowest") > 0)
    return told.join(cells, KCET_CONTEXT).select("request_id", "n_cells", _flag(fits).alias("fits"))


@query
def feature_importance(spark, sf_dir):
    """All inputs of a model; their shares are known and make 1."""
    rows = features.comedk_features(_yearly_table(spark, sf_dir), as_of=True)
    model = models.train_regressor(materialise(rows, "comedk"), models.COMEDK_SPEC, **BOOSTED)
    top = models.feature_importance(spark, model, 100)
    whole = F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9
    return top.select("feature", _flag((F.col("importance") >= 0) & whole).alias("shared"))


TUNED = {"maxIter": (5, 15), "maxDepth": (2, 5), "stepSize": (0.05, 0.4)}


@query
def tune_regressor(spark, sf_dir):
    """Trials of the search: settings within the ranges, folds fitted, best against the first."""
    trials = models.tune_regressor(
        _neet_rows(spark, sf_dir), models.NEET_SPEC, features.NEET_KEYS, TUNED, 8, folds=3
    )
    best, first = models.best_trial(trials).rmse, trials[0].rmse
    rows = [
        (
            t.number,
            int(all(low <= t.settings[k] <= high for k, (low, high) in TUNED.items())),
            int(t.folds == (0 if t.rmse is None else 3)),
            int(best <= first),
        )
        for t in trials
    ]
    return spark.createDataFrame(rows, "trial INT, in_range INT, folds_told INT, no_worse INT")


@query
def model_artifacts(spark, sf_dir):
    """The saved and loaded model against the one in memory, over all rows."""
    rows = _neet_rows(spark, sf_dir)
    model = models.train_regressor(rows, models.NEET_SPEC, **BOOSTED)
    path = scratch_dir(spark, "artifacts")
    models.save_artifacts(path, model, features.history_lists(_yearly(spark, sf_dir)))
    loaded, history = models.load_artifacts(spark, path)
    pred = F.col("pred_closing_rank")
    both = models.score_ranks(model, rows).select(*features.NEET_KEYS, pred.alias("memory"))
    both = both.join(models.score_ranks(loaded, rows).select(*features.NEET_KEYS, pred), features.NEET_KEYS)
    gap = F.max(F.abs(F.col("memory") - pred)).alias("max_gap")
    lists = history.agg(F.count(F.lit(1)).alias("n_histories"))
    told = both.agg(F.count(F.lit(1)).alias("n_rows"), gap)
    return told.withColumn("n_histories", lists.scalar())
