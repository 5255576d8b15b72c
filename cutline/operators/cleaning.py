"""Cleaning of raw rows. Filters come first so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.ranks import (
    as_number,
    canonical_category,
    canonical_pool,
    infer_segment,
)
from cutline.functions.text import one_line, strip_links, upper_trim, vocab_text
from cutline.operators.reshape import keep_highest
from cutline.sources.readers import below, year_of
from cutline.sources.schemas import COMEDK_CLEAN, COMEDK_NAMES, KCET_NAMES, NEET_NAMES

# Fixed values.
JEE_REQUIRED = [
    "year", "quota", "pool", "category", "closing_rank", "opening_rank",
    "institute_short", "program_name", "institute_type",
]
FINAL_ROUNDS = [6, 7]
COMEDK_CATEGORIES = ["GM", "KKR"]


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drops rows with NULL in any of ``cols``."""
    return df.dropna(subset=cols)


def positive(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c) > 0)
    return df


def sane_ranks(df: DataFrame) -> DataFrame:
    ordered = F.col("closing_rank") >= F.col("opening_rank")
    return positive(df, "closing_rank", "opening_rank").filter(ordered)


def final_rounds(df: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Keeps the allowed rounds and no preparatory seats; NULL fails both tests."""
    allowed = FINAL_ROUNDS if rounds is None else rounds
    return df.filter(F.col("round_no").isin(allowed) & (F.col("is_preparatory") == 0))


def normalise_allotment(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return df.withColumns(
        {
            "quota": upper_trim("quota"),
            "pool": canonical_pool(F.trim("pool")),
            "category": canonical_category(upper_trim("category"), aliases),
            "institute_type": upper_trim("institute_type"),
            "institute_short": F.trim("institute_short"),
            "program_name": F.trim("program_name"),
            "degree_short": strip_links(F.trim("degree_short")),
        }
    )


def clean_jee(df: DataFrame) -> DataFrame:
    return normalise_allotment(final_rounds(sane_ranks(require(df, JEE_REQUIRED))))


def with_segment(df: DataFrame) -> DataFrame:
    """``institute_type`` in upper case, or inferred from the name where there is none."""
    if "institute_type" in df.columns:
        return df.withColumn("institute_type", vocab_text("institute_type"))
    return df.withColumn("institute_type", infer_segment("institute_short"))


def audit_files(
    df: DataFrame, base_path: str, valid: Column, year: Column | None = None
) -> DataFrame:
    """Rows per input file: read, dated by ``year`` (by default from the path), dated and valid,
    dropped.

    One aggregate over the raw rows: a task that runs again counts once, and rows of files without
    a year are seen before they leave. Rows have to come straight from a scan.
    """
    file = below(base_path)
    year = year_of(file) if year is None else year
    told = df.select(
        file.alias("file"), valid.alias("__valid"), year.isNotNull().alias("__dated")
    )
    kept = F.col("__dated") & F.coalesce("__valid", F.lit(False))
    return told.groupBy("file").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("__dated").alias("dated_rows"),
        F.count_if(kept).alias("valid_rows"),
        F.count_if(~kept).alias("dropped_rows"),
    )


def valid_neet() -> Column:
    """The rows that :func:`clean_neet` keeps."""
    return F.col("Rank").isNotNull() & F.col("Institute").isNotNull() & (F.col("Rank") > 0)


def clean_neet(df: DataFrame) -> DataFrame:
    """Expects ``year`` from :func:`cutline.sources.readers.with_source_year`."""
    shaped = df.filter(valid_neet()).withColumn("Allotted Category", upper_trim("Allotted Category"))
    return shaped.withColumnsRenamed(NEET_NAMES)


def clean_kcet(df: DataFrame) -> DataFrame:
    valid = positive(require(df, ["Cutoff_Rank", "CollegeName", "CourseName"]), "Cutoff_Rank")
    shaped = valid.withColumns(
        {"Category": upper_trim("Category"), "Base_Category": upper_trim("Base_Category")}
    )
    return shaped.withColumnsRenamed(KCET_NAMES)


def shape_comedk_long(df: DataFrame) -> DataFrame:
    """One row per seat from the long file; texts trimmed, rank a number or NULL."""
    named = df.withColumnsRenamed(COMEDK_NAMES)
    shaped = named.withColumns(
        {
            "college_code": F.trim("college_code"),
            "college_name": F.trim("college_name"),
            "category": upper_trim("category"),
            "course_name": F.trim("course_name"),
            "rank": as_number("rank"),
        }
    )
    return shaped.select("college_code", "college_name", "category", "course_name", "rank")


def clean_comedk_long(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Valid rows of the allowed categories, one per seat and year (highest rank kept)."""
    allowed = COMEDK_CATEGORIES if categories is None else categories
    valid = positive(
        require(df, ["college_code", "college_name", "course_name", "rank"]), "rank"
    ).filter(F.col("category").isin(allowed))
    keys = ["college_code", "college_name", "category", "course_name", "year"]
    names = [f.strip().split(" ")[0] for f in COMEDK_CLEAN.split(",")]
    return keep_highest(valid, keys, "rank").select(*names)


def clean_comedk_wide(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Unpivoted wide rows: texts on one line, allowed categories, positive ranks.

    A missing text cell stays NULL (it does not become the word "nan").
    """
    allowed = COMEDK_CATEGORIES if categories is None else categories
    shaped = df.withColumns(
        {
            "college_code": one_line("college_code"),
            "college_name": one_line("college_name"),
            "category": F.upper(one_line("category")),
            "course_name": one_line("course_name"),
            "rank": as_number("rank"),
        }
    )
    return shaped.filter(F.col("category").isin(allowed) & (F.col("rank") > 0))


def audit(df: DataFrame) -> DataFrame:
    """Row counts after each cleaning rule, in one pass over the raw rows."""
    present = F.lit(True)
    for c in JEE_REQUIRED:
        present = present & F.col(c).isNotNull()
    sane = (
        (F.col("closing_rank") > 0)
        & (F.col("opening_rank") > 0)
        & (F.col("closing_rank") >= F.col("opening_rank"))
    )
    last = F.col("round_no").isin(FINAL_ROUNDS)
    regular = F.col("is_preparatory") == 0
    clean = present & sane & last & regular
    return df.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(present).alias("complete_rows"),
        F.count_if(present & sane).alias("sane_rows"),
        F.count_if(present & sane & last).alias("final_round_rows"),
        F.count_if(clean).alias("clean_rows"),
    ).withColumn("dropped_rows", F.col("raw_rows") - F.col("clean_rows"))
