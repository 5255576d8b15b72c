"""Plain SQL for each registered query that SQL can state, for the checking engine."""

from __future__ import annotations

from cutline.functions.text import STRIP_CODES
from cutline.operators.models import COMEDK_CATEGORICAL, COMEDK_NUMERIC
from cutline.plans.fixtures import with_views

JEE = "institute_type, institute_short, program_name, degree_short, category, quota, pool"
SEAT = "college_name, course_name, category"
STRIP = " || ".join(f"chr({c})" for c in STRIP_CODES)
COMPLETE = (
    "year IS NOT NULL AND quota IS NOT NULL AND pool IS NOT NULL AND category IS NOT NULL "
    "AND closing_rank IS NOT NULL AND opening_rank IS NOT NULL AND institute_short IS NOT NULL "
    "AND program_name IS NOT NULL AND institute_type IS NOT NULL"
)
SANE = "closing_rank > 0 AND opening_rank > 0 AND closing_rank >= opening_rank"
LINK = r"'\[([^\]]+)\]\([^)]+\)', '\1', 'g'"


def digest(*parts: str) -> str:
    text = ", ".join(["'42'", *parts])
    return f"md5(concat_ws('|', {text}))"


def chance(*parts: str) -> str:
    return f"CAST('0x' || substr({digest(*parts)}, 1, 8) AS BIGINT)"


def same(left: str, right: str, cols: str) -> str:
    return " AND ".join(
        f"{left}.{c.strip()} IS NOT DISTINCT FROM {right}.{c.strip()}" for c in cols.split(",")
    )


# Named parts used by several queries.
PARTS = {
    "jee_norm": f"""
SELECT upper(trim(quota, ' ')) AS quota,
  CASE WHEN lower(pool) LIKE '%female%' THEN 'Female-Only' ELSE 'Gender-Neutral' END AS pool,
  CASE upper(trim(category, ' ')) WHEN 'EWS' THEN 'GEN-EWS' WHEN 'OPEN' THEN 'GEN'
    ELSE upper(trim(category, ' ')) END AS category,
  upper(trim(institute_type, ' ')) AS institute_type, trim(institute_short, ' ') AS institute_short,
  trim(program_name, ' ') AS program_name,
  regexp_replace(trim(degree_short, ' '), {LINK}) AS degree_short,
  year AS year, round_no, is_preparatory, opening_rank, closing_rank FROM fx_allotment""",
    "jee_clean": f"""
SELECT * FROM jee_norm WHERE {COMPLETE} AND {SANE} AND round_no IN (6, 7)
  AND is_preparatory = 0""",
    "per_year": f"""
SELECT {JEE}, year AS year, max(closing_rank) AS closing_rank_year,
  min(opening_rank) AS opening_rank_year,
  max(closing_rank) - min(opening_rank) AS rank_spread_year
FROM jee_clean GROUP BY {JEE}, year""",
    "multi_raw": f"""
SELECT {JEE}, max(closing_rank_year) AS closing_rank_max,
  min(opening_rank_year) AS opening_rank_min, avg(closing_rank_year) AS closing_rank_avg,
  coalesce(stddev_samp(closing_rank_year), 0) AS closing_rank_std,
  coalesce(avg(rank_spread_year), 0) AS rank_spread_avg, max(year) AS latest_year,
  count(year) AS years_available
FROM per_year GROUP BY {JEE}""",
    "year_order": f"""
SELECT *, row_number() OVER (PARTITION BY {JEE} ORDER BY year DESC) AS rn FROM per_year""",
    "trend_raw": f"""
SELECT {", ".join("l." + c.strip() for c in JEE.split(","))}, l.year AS year,
  l.closing_rank_year AS cr_latest, p.closing_rank_year AS cr_prev
FROM year_order l LEFT JOIN year_order p ON p.rn = 2 AND {same("l", "p", JEE)}
WHERE l.rn = 1""",
    "trend_part": f"""
SELECT {JEE},
  CASE WHEN degree_short IS NOT NULL THEN cr_latest - cr_prev END AS yoy_rank_change,
  CASE WHEN degree_short IS NULL THEN NULL WHEN cr_prev IS NULL THEN 'UNKNOWN'
    WHEN cr_latest - cr_prev > 50 THEN 'UP' WHEN cr_latest - cr_prev < -50 THEN 'DOWN'
    ELSE 'STABLE' END AS trend_direction
FROM trend_raw""",
    "difficulty": f"""
SELECT {JEE}, round(100 * percent_rank() OVER (PARTITION BY institute_type, category, quota, pool
  ORDER BY closing_rank_avg), 1) AS difficulty_pct FROM multi_raw""",
    "jee_feat": f"""
SELECT m.*, t.yoy_rank_change, t.trend_direction,
  CASE WHEN opening_rank_min > 0 THEN round(closing_rank_avg / opening_rank_min, 3) END
    AS rank_pressure, d.difficulty_pct
FROM multi_raw m JOIN trend_part t ON {same("m", "t", JEE)}
  JOIN difficulty d ON {same("m", "d", JEE)}""",
    "yearly": """
SELECT institute AS college_name, course AS course_name, category, year AS year,
  max(rank) AS closing_rank FROM fx_ranked
WHERE rank > 0 GROUP BY institute, course, category, year""",
    "lagged": f"""
SELECT *, lag(closing_rank) OVER (PARTITION BY {SEAT} ORDER BY year) AS lagged_rank
FROM yearly""",
    "seat_trend": f"""
SELECT {SEAT}, avg(closing_rank) AS closing_rank_mean,
  coalesce(stddev_samp(closing_rank), 0) AS closing_rank_std,
  min(closing_rank) AS closing_rank_min, max(closing_rank) AS closing_rank_max,
  count(DISTINCT year) AS years_available, max(year) AS latest_year,
  min(year) AS earliest_year, max(closing_rank) - min(closing_rank) AS rank_trend
FROM yearly GROUP BY {SEAT}""",
    "known_values": """
SELECT DISTINCT upper(institute) AS value FROM fx_ranked WHERE region <> 'ASIA'
UNION SELECT '__UNKNOWN__'""",
    "known": """
SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM known_values""",
    "candidates": """
SELECT DISTINCT s.segment, upper(f.quota) AS quota_key, lower(f.pool) AS pool_key,
  upper(f.category) AS category_key, institute_short, program_name, degree_short,
  closing_rank_max, opening_rank_min
FROM multi_raw f JOIN (SELECT CASE WHEN lower(exam_type) LIKE '%advanced%' THEN 'IIT' ELSE 'NIT' END
    AS segment, quota, pool, category FROM fx_requests) s
  ON upper(s.quota) = upper(f.quota) AND lower(s.pool) = lower(f.pool)
  AND upper(s.category) = upper(f.category) AND (s.segment = 'IIT') = (f.institute_type = 'ASIA')""",
    "kcet_contexts": """
SELECT DISTINCT upper(category) AS category, upper(base_category) AS base_category,
  upper(quota) AS quota, upper(region) AS region FROM fx_requests""",
    "kcet_cells": """
SELECT college_name, course_name FROM (SELECT DISTINCT upper(institute) AS college_name FROM fx_ranked),
  (SELECT DISTINCT upper(course) AS course_name FROM fx_ranked)""",
    "neet_rows": f"""
SELECT institute, course, category, quota, year AS year, max(rank) AS closing_rank
FROM fx_ranked GROUP BY institute, course, category, quota, year""",
    "contexts": """
SELECT DISTINCT category, user_rank FROM fx_requests""",
    "eval_hash": f"""
SELECT l_orderkey, l_linenumber, label, {chance("l_orderkey", "l_linenumber")} AS h
FROM fx_eval""",
}


def grouped(keys: str, source: str) -> str:
    return f"""SELECT {keys}, max(rank) AS closing_rank, round(avg(rank), 4) AS closing_rank_avg,
  round(coalesce(stddev_samp(rank), 0), 4) AS closing_rank_std,
  max(year) AS latest_recorded_year FROM {source} GROUP BY {keys}"""


# Per rule: the value that is compared and ordered, the order, tier conditions, and the tiers as
# intervals of the order (first and last place) from counts of the group's rows.
WHOLE = "CAST(floor(pred_closing_rank) AS BIGINT)"


def window_rule(window: int) -> dict[str, str]:
    high, low = "pred_closing_rank > user_rank", f"pred_closing_rank > user_rank - {window}"
    return {
        "value": "pred_closing_rank", "order": "DESC", "safe": high, "likely": f"{low} AND NOT {high}",
        "safe_first": "1", "safe_last": f"count(*) FILTER ({high})",
        "likely_first": f"count(*) FILTER ({high}) + 1", "likely_last": f"count(*) FILTER ({low})",
    }


COMEDK = {
    "value": WHOLE, "order": "ASC", "safe": f"{WHOLE} > user_rank",
    "likely": f"{WHOLE} >= greatest(1, user_rank - 1000) AND {WHOLE} <= user_rank",
    "safe_first": f"count(*) FILTER ({WHOLE} <= user_rank) + 1", "safe_last": "count(*)",
    "likely_first": f"count(*) FILTER ({WHOLE} < greatest(1, user_rank - 1000)) + 1",
    "likely_last": f"count(*) FILTER ({WHOLE} <= user_rank)",
}
NEET, KCET = window_rule(1500), window_rule(5000)


def answer_rows(rule: dict[str, str]) -> str:
    """Every programme of every tier of every request, with its position."""
    return f"""
tiered AS (SELECT q.category, q.user_rank, s.institute, s.course, {WHOLE} AS predicted_cutoff,
  {rule["value"]} AS v, CASE WHEN {rule["safe"]} THEN 'Safe' WHEN {rule["likely"]} THEN 'Likely' END AS tier
  FROM contexts q JOIN fx_scored s ON q.category = s.category),
placed AS (SELECT *, row_number() OVER (PARTITION BY category, user_rank, tier
  ORDER BY v {rule["order"]}, institute, course) AS pos
  FROM tiered WHERE tier IS NOT NULL)"""


def gap(rule: dict[str, str], first: int, last: int) -> str:
    return f"""{answer_rows(rule)}
SELECT category, user_rank, tier, pos, institute, course, predicted_cutoff
FROM placed WHERE pos BETWEEN {first} AND {last}"""


def complete(rule: dict[str, str], pos: bool = True) -> str:
    shown = "pos, " if pos else ""
    return f"""{answer_rows(rule)}
SELECT category, user_rank, tier, {shown}institute, course, predicted_cutoff FROM placed"""


def catalogue_order(rule: dict[str, str]) -> str:
    return f"""
ordered AS (SELECT category, row_number() OVER (PARTITION BY category
  ORDER BY {rule["value"]} {rule["order"]}, institute, course) AS place, institute, course,
  {WHOLE} AS predicted_cutoff FROM fx_scored)"""


def intervals(rule: dict[str, str]) -> str:
    return f"""{catalogue_order(rule)},
counted AS (SELECT q.category, q.user_rank,
  {", ".join(f"{rule[c]} AS {c}" for c in ("safe_first", "safe_last", "likely_first", "likely_last"))}
  FROM contexts q JOIN fx_scored s ON q.category = s.category GROUP BY 1, 2),
runs AS (SELECT category, user_rank, 'Safe' AS tier, safe_first AS f, safe_last AS l FROM counted
  UNION ALL SELECT category, user_rank, 'Likely', likely_first, likely_last FROM counted)
SELECT 'answer' AS part, category, user_rank, tier, f AS first, l AS last, NULL AS place,
  NULL AS institute, NULL AS course, NULL AS predicted_cutoff FROM runs WHERE f <= l
UNION ALL SELECT 'catalogue', category, NULL, NULL, NULL, NULL, place, institute, course,
  predicted_cutoff FROM ordered"""


def tier_ends(rule: dict[str, str]) -> str:
    ends = [
        f"{pick}({c}, pos) AS {end}_{name}"
        for end, pick in (("first", "arg_min"), ("last", "arg_max"))
        for c, name in (("institute",) * 2, ("course",) * 2, ("predicted_cutoff", "cutoff"))
    ]
    return f"""{answer_rows(rule)}
SELECT category, user_rank, tier, count(*) AS n_rows, {", ".join(ends)}
FROM placed GROUP BY category, user_rank, tier"""


FEATURE_ROUNDED = f"""SELECT {JEE}, closing_rank_max, opening_rank_min,
  round(closing_rank_avg, 4) AS closing_rank_avg, round(closing_rank_std, 4) AS closing_rank_std,
  round(rank_spread_avg, 4) AS rank_spread_avg, latest_year, years_available"""

TOP_N = """
kept AS (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY eligibility_prob DESC, institute, course) AS pos
  FROM fx_scored WHERE round(eligibility_prob, 4) >= 0.40)
SELECT category, pos, institute, course, eligibility_prob FROM kept WHERE pos <= 20"""


def nulls(col: str) -> str:
    return f"count(*) FILTER (WHERE {col} IS NULL) AS {col}"


JEE_FEATURE_COLUMNS = [
    *[c.strip() for c in JEE.split(",")], "closing_rank_max", "opening_rank_min",
    "closing_rank_avg", "closing_rank_std", "rank_spread_avg", "latest_year",
    "years_available", "yoy_rank_change", "trend_direction", "rank_pressure", "difficulty_pct",
]

WIDE_COURSES = ["economy", "promo", "standard", "medium", "large", "small"]
LONG_IDS = "institute, category, year AS year"
UNPIVOT = f"""
SELECT institute, category, year AS year, course_name, rank FROM (
  {" UNION ALL ".join(f"SELECT {LONG_IDS}, 'c_{c}' AS course_name, c_{c} AS rank FROM fx_wide"
                      for c in WIDE_COURSES)})"""

BODIES = {
    "scan_csv_schema": "SELECT * FROM fx_ranked",
    "scan_csv_dir": """SELECT institute, year AS year, count(*) AS n_rows, sum(rank) AS sum_rank
FROM fx_ranked GROUP BY institute, year""",
    "scan_csv_multiline": """SELECT doc_id, lang, source, md5(text) AS text_md5,
  CAST(length(text) AS BIGINT) AS n_chars FROM documents""",
    "source_year": "SELECT year AS year, count(*) AS n_rows FROM fx_ranked GROUP BY year",
    "scan_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "roundtrip_partitioned": """SELECT year AS year, category, count(*) AS n_rows FROM fx_ranked
GROUP BY year, category""",
    "split_segment": """SELECT
  CASE WHEN institute_type = 'ASIA' THEN 'iit' ELSE 'nit' END AS segment, category, quota, count(*) AS n_rows FROM jee_clean GROUP BY 1, 2, 3""",
    "catalog_register": "SELECT year AS year, count(*) AS n_rows FROM fx_ranked GROUP BY year",
    "csv_sink": TOP_N,
    "clean_required": f"""SELECT * FROM fx_allotment WHERE {COMPLETE}
  AND degree_short IS NOT NULL""",
    "clean_rank_sanity": f"SELECT * FROM fx_allotment WHERE {SANE}",
    "filter_rounds": "SELECT * FROM fx_allotment WHERE round_no IN (6, 7) AND is_preparatory = 0",
    "filter_category": "SELECT * FROM fx_ranked WHERE category IN ('BUILDING', 'MACHINERY')",
    "canon_pool": """SELECT pool, CASE WHEN lower(pool) LIKE '%female%' THEN 'Female-Only'
  ELSE 'Gender-Neutral' END AS canonical, count(*) AS n_rows FROM fx_allotment GROUP BY 1, 2""",
    "canon_category": """SELECT category, CASE upper(trim(category, ' '))
  WHEN 'BUILDING' THEN 'GEN-EWS' WHEN 'MACHINERY' THEN 'GEN'
  ELSE upper(trim(category, ' ')) END AS canonical, count(*) AS n_rows
FROM fx_allotment GROUP BY 1, 2""",
    "normalise_strings": """SELECT quota, category, institute_type, institute_short, program_name,
  count(*) AS n_rows FROM jee_norm GROUP BY 1, 2, 3, 4, 5""",
    "strip_links": f"""SELECT degree_short, regexp_replace(degree_short, {LINK}) AS degree,
  count(*) AS n_rows FROM fx_allotment GROUP BY 1, 2""",
    "clean_newlines": f"""
lines AS (SELECT doc_id,
  replace(replace(trim(text, {STRIP}), chr(10), ' '), chr(13), '') AS line FROM documents)
SELECT doc_id, md5(line) AS line_md5, CAST(length(line) AS BIGINT) AS n_line FROM lines""",
    "coerce_numeric": """SELECT institute, category, year AS year,
  TRY_CAST(c_small AS DOUBLE) AS small_rank, TRY_CAST(c_economy AS DOUBLE) AS economy_rank
FROM fx_wide""",
    "project_rename": """SELECT institute AS college_name, course AS course_name, category,
  year AS year, rank AS cutoff_rank, 'ranked' AS source FROM fx_ranked""",
    "infer_segment": """SELECT institute,
  CASE WHEN upper(institute) LIKE '%1%' THEN 'IIT' ELSE 'NIT' END AS segment,
  count(*) AS n_rows FROM fx_ranked GROUP BY 1, 2""",
    "ingest_audit": f"""
marks AS (SELECT ({COMPLETE}) AS c, ({SANE}) AS s, round_no IN (6, 7) AS l,
  is_preparatory = 0 AS r FROM fx_allotment)
SELECT count(*) AS raw_rows, count(*) FILTER (WHERE c) AS complete_rows,
  count(*) FILTER (WHERE c AND s) AS sane_rows,
  count(*) FILTER (WHERE c AND s AND l) AS final_round_rows,
  count(*) FILTER (WHERE c AND s AND l AND r) AS clean_rows,
  count(*) - count(*) FILTER (WHERE c AND s AND l AND r) AS dropped_rows FROM marks""",
    "ingest_audit_files": """
dealt AS (SELECT CASE WHEN quota = 'P' THEN 'part=undated' ELSE 'part=' || year END AS folder,
  quota <> 'P' AS dated, rank > 20000 AS valid FROM fx_ranked)
SELECT folder, count(*) AS raw_rows, count(*) FILTER (dated) AS dated_rows,
  count(*) FILTER (dated AND valid) AS valid_rows,
  count(*) FILTER (NOT (dated AND valid)) AS dropped_rows FROM dealt GROUP BY folder""",
    "scan_first_existing": "SELECT year AS year, count(*) AS n_rows FROM fx_ranked GROUP BY year",
    "scan_uri": "SELECT category, count(*) AS n_rows, 1 AS has_scheme FROM fx_ranked GROUP BY category",
    "scan_missing_year": """
asked AS (SELECT unnest([0, 1, 2, 2]) AS asked, unnest([1900, 1996, 1995, 1996]) AS y)
SELECT asked, count(rank) AS n_rows, max(rank) AS highest
FROM asked LEFT JOIN fx_ranked ON year = y GROUP BY asked""",
    "preview_rows": "SELECT least(5, count(*)) AS n_rows, least(5, count(*)) AS n_known FROM fx_ranked",
    "align_columns": "SELECT institute, year AS year, rank, 0 AS spread, 0 AS trend FROM fx_ranked",
    "partition_counts": """SELECT year AS year, institute_type, category, count(*) AS n_rows
FROM jee_clean GROUP BY year, institute_type, category""",
    "jee_per_year": "SELECT * FROM per_year",
    "jee_multi_year": f"{FEATURE_ROUNDED} FROM multi_raw",
    "jee_latest_prev": "SELECT * FROM trend_raw",
    "jee_trend": "SELECT * FROM trend_part",
    "jee_rank_pressure": f"SELECT {JEE}, rank_pressure FROM jee_feat",
    "jee_difficulty": "SELECT * FROM difficulty",
    "jee_features": f"""{FEATURE_ROUNDED}, yoy_rank_change, trend_direction, rank_pressure,
  difficulty_pct FROM jee_feat""",
    "legacy_features": """SELECT *, closing_rank - opening_rank AS rank_spread,
  coalesce(CAST(regexp_matches(degree_short, '(?i)PROMO|SMALL') AS INT), 0) AS is_dual_degree,
  CAST(upper(quota) = 'HS' AS INT) AS is_home_state,
  CAST(lower(pool) LIKE '%female%' AS INT) AS is_female_pool,
  CAST(category LIKE '%PWD%' AS INT) AS is_pwd, CAST(category LIKE '%EWS%' AS INT) AS is_ews,
  round(CAST(round_no AS DOUBLE) / 7, 4) AS round_norm,
  year - (SELECT min(year) FROM jee_clean) AS year_offset FROM jee_clean""",
    "neet_features": grouped("institute, course, category, quota, year", "fx_ranked"),
    "kcet_features": f"""
named AS (SELECT institute AS college_name, course AS course_name, category, base_category,
  quota, region, year AS year, rank FROM fx_ranked)
{grouped("college_name, course_name, category, base_category, quota, region, year", "named")}""",
    "comedk_simple": f"""
named AS (SELECT institute AS college_name, course AS course_name, category, year AS year, rank
  FROM fx_ranked WHERE rank > 0)
{grouped(SEAT + ", year", "named")}""",
    "comedk_yearly": "SELECT * FROM yearly",
    "comedk_trend": f"""SELECT {SEAT}, round(closing_rank_mean, 4) AS closing_rank_mean,
  round(closing_rank_std, 4) AS closing_rank_std, closing_rank_min, closing_rank_max,
  years_available, latest_year, earliest_year, rank_trend FROM seat_trend""",
    "comedk_lag": f"""SELECT {SEAT}, year AS year, closing_rank, round(coalesce(lagged_rank,
  avg(lagged_rank) OVER (PARTITION BY {SEAT}), closing_rank), 4) AS prev_year_closing_rank
FROM lagged""",
    "comedk_college_avg": f"""SELECT {SEAT}, year AS year, closing_rank,
  round(avg(closing_rank) OVER (PARTITION BY college_name, year), 4) AS college_avg_rank
FROM yearly""",
    "comedk_category_avg": f"""SELECT {SEAT}, year AS year, closing_rank,
  round(avg(closing_rank) OVER (PARTITION BY {SEAT}), 4) AS category_avg_rank FROM yearly""",
    "comedk_features": f"""SELECT l.college_name, l.course_name, l.category, l.year AS year,
  l.closing_rank, round(coalesce(lagged_rank, avg(lagged_rank) OVER (PARTITION BY
    l.college_name, l.course_name, l.category), closing_rank), 4) AS prev_year_closing_rank,
  round(closing_rank_mean, 4) AS closing_rank_mean, round(closing_rank_std, 4) AS closing_rank_std,
  closing_rank_min, closing_rank_max, rank_trend, years_available, latest_year, earliest_year,
  round(avg(closing_rank) OVER (PARTITION BY l.college_name, l.year), 4) AS college_avg_rank,
  round(closing_rank_mean, 4) AS category_avg_rank
FROM lagged l JOIN seat_trend t ON {same("l", "t", SEAT)}""",
    "comedk_features_as_of": f"""SELECT {SEAT}, year AS year, closing_rank,
  (SELECT round(arg_max(o.closing_rank, o.year), 4) FROM yearly o
    WHERE {same("o", "l", SEAT)} AND o.year < l.year) AS prev_year_closing_rank,
  round(avg(closing_rank) OVER w, 4) AS closing_rank_mean,
  round(coalesce(stddev_samp(closing_rank) OVER w, 0), 4) AS closing_rank_std,
  min(closing_rank) OVER w AS closing_rank_min, max(closing_rank) OVER w AS closing_rank_max,
  max(closing_rank) OVER w - min(closing_rank) OVER w AS rank_trend,
  count(year) OVER w AS years_available, max(year) OVER w AS latest_year,
  min(year) OVER w AS earliest_year,
  (SELECT round(avg(o.closing_rank), 4) FROM yearly o
    WHERE o.college_name = l.college_name AND o.year < l.year) AS college_avg_rank,
  round(avg(closing_rank) OVER w, 4) AS category_avg_rank
FROM yearly l WINDOW w AS (PARTITION BY {SEAT} ORDER BY year
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "history_list": f"""SELECT {SEAT},
  string_agg(CAST(CAST(closing_rank AS BIGINT) AS VARCHAR), ',' ORDER BY year) AS history
FROM yearly GROUP BY {SEAT}""",
    "history_stats": f"""SELECT {SEAT}, 2002 AS year,
  arg_max(closing_rank, year) AS prev_year_closing_rank,
  round(avg(closing_rank), 4) AS closing_rank_mean,
  round(stddev_pop(closing_rank), 4) AS closing_rank_std,
  min(closing_rank) AS closing_rank_min, max(closing_rank) AS closing_rank_max,
  max(closing_rank) - min(closing_rank) AS rank_trend, count(*) AS years_available,
  2001 AS latest_year, 2002 - count(*) AS earliest_year,
  round(avg(closing_rank), 4) AS college_avg_rank,
  round(avg(closing_rank), 4) AS category_avg_rank FROM yearly GROUP BY {SEAT}""",
    "fill_constant": """SELECT institute_type, institute_short, program_name,
  coalesce(degree_short, 'UNKNOWN') AS degree_short, category, quota, pool,
  coalesce(yoy_rank_change, 0) AS yoy_rank_change,
  coalesce(trend_direction, 'UNKNOWN') AS trend_direction FROM trend_part""",
    "fill_median": f"""
joined AS (SELECT m.*, t.yoy_rank_change FROM multi_raw m
  JOIN trend_part t ON {same("m", "t", JEE)})
SELECT {JEE}, coalesce(CAST(yoy_rank_change AS DOUBLE),
    (SELECT median(yoy_rank_change) FROM joined)) AS yoy_rank_change,
  round(closing_rank_std, 4) AS closing_rank_std FROM joined""",
    "profile_distinct": """SELECT count(DISTINCT year) AS n_year,
  count(DISTINCT institute) AS n_institute, count(DISTINCT course) AS n_course,
  count(DISTINCT category) AS n_category FROM fx_ranked""",
    "profile_target": """SELECT min(closing_rank) AS lowest, max(closing_rank) AS highest,
  round(avg(closing_rank), 4) AS mean, count(*) AS n_rows FROM yearly""",
    "profile_nulls": f"SELECT {', '.join(map(nulls, JEE_FEATURE_COLUMNS))} FROM jee_feat",
    "vocab_build": """
names AS (SELECT DISTINCT upper(institute) AS value FROM fx_ranked)
SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM names""",
    "vocab_unknown": """SELECT institute, coalesce(id,
    (SELECT id FROM known WHERE value = '__UNKNOWN__')) AS institute_id, year AS year,
  count(*) AS n_rows FROM fx_ranked LEFT JOIN known ON upper(institute) = value
GROUP BY 1, 2, 3""",
    "vocab_semi": """SELECT institute, year AS year, count(*) AS n_rows FROM fx_ranked
WHERE upper(institute) IN (SELECT value FROM known_values) GROUP BY institute, year""",
    "unpivot_courses": UNPIVOT,
    "comedk_wide": f"""
long AS ({UNPIVOT}),
named AS (SELECT institute AS college_name, course_name, upper(category) AS category,
  year AS year, TRY_CAST(rank AS DOUBLE) AS rank FROM long
  WHERE category IN ('BUILDING', 'MACHINERY') AND TRY_CAST(rank AS DOUBLE) > 0)
{grouped(SEAT + ", year", "named")}""",
    "union_years": "SELECT institute, course, category, rank, year AS year FROM fx_ranked",
    "dedup_latest": """SELECT institute, course, category, year AS year, max(rank) AS rank
FROM fx_ranked GROUP BY institute, course, category, year""",
    "sample_pos_neg": f"""
draws AS (SELECT m.*, d.draw, greatest(1, opening_rank_min) AS lo, closing_rank_max AS hi,
    {chance(JEE, "draw")} AS h
  FROM multi_raw m, (SELECT 0 AS draw UNION ALL SELECT 1) d)
SELECT {JEE}, draw, CASE WHEN draw = 0 THEN lo + h % (hi - lo + 1)
    ELSE hi + 1 + h % (greatest(500001, hi + 2) - hi - 1) END AS student_rank,
  CASE WHEN draw = 0 THEN 1 ELSE 0 END AS eligible FROM draws WHERE lo <= hi""",
    "split_hash": """SELECT l_orderkey, l_linenumber,
  CASE WHEN h % 100 < 15 THEN 1 ELSE 0 END AS is_test FROM eval_hash""",
    "split_stratified": """
placed AS (SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY h, l_orderkey, l_linenumber) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM eval_hash)
SELECT l_orderkey, l_linenumber, label,
  CASE WHEN rn <= ceil(n * 15 / 100) THEN 1 ELSE 0 END AS is_test FROM placed""",
    "split_stratified_many": f"""
hashed AS (SELECT l_orderkey, l_linenumber, nullif(l_suppkey, 1) AS supplier,
  {digest("l_orderkey", "l_linenumber")} AS h FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY h) AS rn,
  count(*) OVER (PARTITION BY supplier) AS n FROM hashed)
SELECT l_orderkey, l_linenumber, supplier,
  CASE WHEN rn <= ceil(n * 15 / 100) THEN 1 ELSE 0 END AS is_test FROM placed""",
    "kfold_assign": """SELECT l_orderkey, l_linenumber, CAST(h % 3 AS INT) AS fold
FROM eval_hash""",
    "class_weights": """
sides AS (SELECT label, count(*) AS n_rows FROM fx_eval GROUP BY label)
SELECT label, n_rows, round((SELECT max(n_rows) FROM sides) / n_rows, 4) AS weight FROM sides""",
    "label_counts": """SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive,
  CAST(sum(1 - label) AS BIGINT) AS n_negative FROM fx_eval""",
    "log_target": f"""SELECT {SEAT}, year AS year, round(ln(1 + closing_rank), 4) AS log_rank,
  CAST(closing_rank AS BIGINT) AS back FROM yearly""",
    "eval_regression": """
e AS (SELECT y_true AS y, abs(y_true - y_pred) AS err,
  abs(y_true - y_pred) / greatest(y_true, 1) AS rel FROM fx_eval)
SELECT count(*) AS n_rows, round(sqrt(avg(err * err)), 4) AS rmse, round(avg(err), 4) AS mae,
  round(1 - sum(err * err) / (var_pop(y) * count(*)), 4) AS r2,
  round(avg(CASE WHEN err <= 500 THEN 100 ELSE 0 END), 4) AS within_500,
  round(avg(CASE WHEN err <= 1000 THEN 100 ELSE 0 END), 4) AS within_1000,
  round(avg(CASE WHEN err <= 2000 THEN 100 ELSE 0 END), 4) AS within_2000,
  round(avg(CASE WHEN rel <= CAST(0.1 AS DOUBLE) THEN 100 ELSE 0 END), 4) AS within_10_pct,
  round(avg(CASE WHEN rel <= CAST(0.2 AS DOUBLE) THEN 100 ELSE 0 END), 4) AS within_20_pct
FROM e""",
    "eval_auc": """
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2
    AS avg_rank FROM fx_eval),
n AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS m
  FROM fx_eval)
SELECT round((sum(avg_rank) - max(p) * (max(p) + 1) / 2) / (CAST(max(p) AS DOUBLE) * max(m)), 8)
    AS auc, max(p) AS n_positive, max(m) AS n_negative FROM r, n WHERE label = 1""",
    "eval_classification": """
c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 50000) AS tp,
  count(*) FILTER (WHERE label = 0 AND score >= 50000) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < 50000) AS fn,
  count(*) FILTER (WHERE label = 0 AND score < 50000) AS tn FROM fx_eval)
SELECT 1 AS class, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 4) AS f1, tp + fn AS support FROM c
UNION ALL SELECT 0, round(tn / (tn + fn), 4), round(tn / (tn + fp), 4),
  round(2 * tn / (2 * tn + fp + fn), 4), tn + fp FROM c""",
    "route_segment": """SELECT request_id,
  CASE WHEN lower(exam_type) LIKE '%advanced%' THEN 'IIT' ELSE 'NIT' END AS segment
FROM fx_requests""",
    "request_dedup": """SELECT user_rank, exam_type, category, quota, pool, count(*) AS n_requests,
  concat_ws('_', 'jee', user_rank, exam_type, category, quota, pool) AS request_key
FROM fx_requests GROUP BY user_rank, exam_type, category, quota, pool""",
    "jee_candidate_match": """
wanted AS (SELECT DISTINCT user_rank, exam_type, category, quota, pool,
  concat_ws('_', 'jee', user_rank, exam_type, category, quota, pool) AS request_key
  FROM fx_requests)
SELECT request_key, institute_type, institute_short, program_name, degree_short,
  closing_rank_max, opening_rank_min
FROM wanted w JOIN multi_raw f ON upper(w.quota) = upper(f.quota)
  AND lower(w.pool) = lower(f.pool) AND upper(w.category) = upper(f.category)
  AND (lower(w.exam_type) LIKE '%advanced%') = (f.institute_type = 'ASIA')""",
    "jee_candidates": "SELECT * FROM candidates",
    "request_answers": f"""
asks AS (SELECT ask_id, category, concat_ws('_', category, quota, pool) AS k,
  CAST(floor(epoch(asked_at)) AS BIGINT) AS s FROM fx_asks),
issues AS (SELECT k, min(s) AS t FROM asks GROUP BY k
  UNION ALL SELECT i.k, min(a.s) FROM issues i JOIN asks a ON a.k = i.k AND a.s >= i.t + 3600
  GROUP BY i.k),
{TOP_N.strip().replace("SELECT category, pos, institute, course, eligibility_prob FROM kept WHERE pos <= 20",
  ", best AS (SELECT category, count(*) AS n_rows, arg_min(institute, pos) AS first_institute FROM kept WHERE pos <= 3 GROUP BY category)")}
SELECT ask_id, max(t) AS issued_at, CASE WHEN max(t) = any_value(a.s) THEN 'model' ELSE 'cache' END AS source,
  coalesce(any_value(n_rows), 0) AS n_rows, any_value(first_institute) AS first_institute
FROM asks a JOIN issues i ON a.k = i.k AND i.t <= a.s LEFT JOIN best b ON a.category = b.category
GROUP BY ask_id""",
    "branch_filter": "SELECT * FROM yearly WHERE lower(course_name) LIKE '%pro%'",
    "kcet_grid": f"""
SELECT category, base_category, quota, region, college_name, course_name, 2002 AS year
FROM kcet_contexts, kcet_cells""",
    "neet_candidates": """
ctx AS (SELECT DISTINCT category FROM fx_requests)
SELECT category, value AS institute, 'MBBS' AS course, 2002 AS year
FROM ctx, (SELECT DISTINCT upper(institute) AS value FROM fx_ranked)""",
    "tier_probability": """
r AS (SELECT institute, course, category, round(eligibility_prob, 4) AS eligibility_prob
  FROM fx_scored)
SELECT *, CASE WHEN eligibility_prob >= 0.70 THEN 'Safe' ELSE 'Likely' END AS tier
FROM r WHERE eligibility_prob >= 0.40""",
    "tier_neet": complete(NEET, pos=False),
    "tier_kcet": complete(KCET, pos=False),
    "tier_comedk": complete(COMEDK, pos=False),
    "tier_order": complete(NEET),
    "tier_order_asc": complete(COMEDK),
    "tier_neet_intervals": intervals(NEET),
    "tier_kcet_intervals": intervals(KCET),
    "tier_comedk_intervals": intervals(COMEDK),
    "tier_order_ends": tier_ends(NEET),
    "tier_order_asc_ends": tier_ends(COMEDK),
    "tier_page": gap(KCET, 41, 60),
    "tier_order_probability": """
r AS (SELECT *, CASE WHEN eligibility_prob >= 0.70 THEN 'Safe' ELSE 'Likely' END AS tier
  FROM fx_scored WHERE eligibility_prob >= 0.40)
SELECT category, tier, row_number() OVER (PARTITION BY category, tier
    ORDER BY eligibility_prob DESC, institute, course) AS pos, institute, course,
  eligibility_prob FROM r""",
    "tier_topk_desc": gap(KCET, 1, 15),
    "tier_topk_asc": gap(COMEDK, 1, 15),
    "threshold_topn": TOP_N,
    "request_summary": """
pairs AS (SELECT q.category, q.user_rank,
    count(*) FILTER (WHERE pred_closing_rank > user_rank) AS n_safe,
    count(*) FILTER (WHERE pred_closing_rank > user_rank - 1500
      AND pred_closing_rank <= user_rank) AS n_likely
  FROM contexts q JOIN fx_scored s ON q.category = s.category GROUP BY 1, 2)
SELECT request_id, coalesce(n_safe, 0) AS n_safe, coalesce(n_likely, 0) AS n_likely,
  CASE WHEN coalesce(n_safe, 0) + coalesce(n_likely, 0) > 0 THEN 1 ELSE 0 END AS has_result
FROM fx_requests q LEFT JOIN pairs p ON q.category = p.category AND q.user_rank = p.user_rank""",
    "nested_response": gap(NEET, 1, 15).replace(
        "SELECT category, user_rank, tier, pos, institute, course, predicted_cutoff\nFROM placed",
        """SELECT category, user_rank,
  coalesce(string_agg(institute || '/' || course || '/' || predicted_cutoff, ',' ORDER BY pos)
    FILTER (WHERE tier = 'Safe'), '') AS safe,
  coalesce(string_agg(institute || '/' || course || '/' || predicted_cutoff, ',' ORDER BY pos)
    FILTER (WHERE tier = 'Likely'), '') AS likely FROM placed""",
    ) + " GROUP BY category, user_rank",
    "response_pages": f"""{catalogue_order(NEET)}
SELECT category, (place - 1) // 100 AS page, place, institute, course, predicted_cutoff
FROM ordered""",
}

BODIES |= {
    "target_means": f"""
dealt AS (SELECT *, ln(1 + closing_rank) AS y,
  CAST({chance("institute", "course", "category", "quota", "year")} % 3 AS INT) AS fold FROM neet_rows),
cells AS (SELECT 'institute' AS "column", upper(institute) AS value, fold, y FROM dealt
  UNION ALL SELECT 'category', upper(category), fold, y FROM dealt
  UNION ALL SELECT '', '', fold, y FROM dealt),
outside AS (SELECT v."column", v.value, f.fold, count(c.y) AS n, coalesce(sum(c.y), 0) AS total
  FROM (SELECT DISTINCT "column", value FROM cells) v
  CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS fold) f
  LEFT JOIN cells c ON c."column" = v."column" AND c.value = v.value AND c.fold <> f.fold
  GROUP BY 1, 2, 3),
priors AS (SELECT fold, total / n AS prior FROM outside WHERE "column" = '')
SELECT "column", value, o.fold, n, round(CASE WHEN "column" = '' THEN prior
  ELSE (total + 10 * prior) / (n + 10) END, 6) AS mean FROM outside o JOIN priors p ON o.fold = p.fold""",
    "train_regressor": f"""
SELECT count(*) AS n_rows, count(*) AS n_ranked, 1 AS reported FROM neet_rows
WHERE {chance("institute", "course", "category", "quota", "year")} % 100 < 15""",
    "train_classifier": f"""
draws AS (SELECT draw, {chance(JEE, "draw").replace("'42'", "'43'")} % 100 < 15 AS held
  FROM multi_raw, (SELECT 0 AS draw UNION ALL SELECT 1)
  WHERE greatest(1, opening_rank_min) <= closing_rank_max)
SELECT count(*) FILTER (held AND draw = 0) AS n_positive, count(*) FILTER (held AND draw = 1)
  AS n_negative, 1 AS beats_chance FROM draws""",
    "score_classifier": """
SELECT segment, quota_key, pool_key, category_key, institute_short, program_name, degree_short,
  1 AS in_range, 1 AS all_bands FROM candidates""",
    "jee_answers": """
asked AS (SELECT request_id, CASE WHEN lower(exam_type) LIKE '%advanced%' THEN 'IIT' ELSE 'NIT' END
    AS segment, upper(quota) AS quota_key, lower(pool) AS pool_key, upper(category) AS category_key
  FROM fx_requests)
SELECT request_id, any_value(a.segment) AS segment, count(c.institute_short) AS n_programmes,
  1 AS within, 1 AS listed, 1 AS told
FROM asked a LEFT JOIN candidates c ON a.segment = c.segment AND a.quota_key = c.quota_key
  AND a.pool_key = c.pool_key AND a.category_key = c.category_key GROUP BY request_id""",
    "score_grid": """SELECT request_id, (SELECT count(*) FROM kcet_cells) AS n_cells, 1 AS fits
FROM fx_requests""",
    "feature_importance": f"""SELECT unnest({[*[f"{c}__mean" for c in COMEDK_CATEGORICAL],
  *COMEDK_NUMERIC]}) AS feature, 1 AS shared""",
    "tune_regressor": """SELECT unnest(range(8)) AS trial, 1 AS in_range, 1 AS folds_told,
  1 AS no_worse""",
    "model_artifacts": f"""SELECT (SELECT count(*) FROM neet_rows) AS n_rows,
  CAST(0 AS DOUBLE) AS max_gap, (SELECT count(*) FROM (SELECT DISTINCT {SEAT} FROM yearly)) AS n_histories""",
}


def oracles() -> dict[str, str]:
    texts = {name: with_views(body, PARTS) for name, body in BODIES.items()}
    # The times of issue follow from one another.
    texts["request_answers"] = texts["request_answers"].replace("WITH ", "WITH RECURSIVE ", 1)
    return texts
