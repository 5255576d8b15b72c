"""Declared schemas of the raw files (fixed values: names, order and types)."""

from __future__ import annotations

JEE_RAW = (
    "id INT, year INT, institute_type STRING, round_no INT, quota STRING, pool STRING, "
    "institute_short STRING, program_name STRING, program_duration STRING, "
    "degree_short STRING, category STRING, opening_rank INT, closing_rank INT, "
    "is_preparatory INT"
)

NEET_RAW = (
    "SNo INT, Rank DOUBLE, `Allotted Quota` STRING, Institute STRING, Course STRING, "
    "`Allotted Category` STRING, `Candidate Category` STRING, Remarks STRING"
)

KCET_RAW = (
    "CollegeID STRING, CollegeName STRING, CourseName STRING, Category STRING, "
    "Cutoff_Rank DOUBLE, Year INT, Base_Category STRING, Quota STRING, Region STRING"
)

NEET_NAMES = {
    "SNo": "sno",
    "Rank": "rank",
    "Allotted Quota": "quota",
    "Institute": "institute",
    "Course": "course",
    "Allotted Category": "category",
    "Candidate Category": "candidate_category",
    "Remarks": "remarks",
}

KCET_NAMES = {
    "CollegeID": "college_id",
    "CollegeName": "college_name",
    "CourseName": "course_name",
    "Category": "category",
    "Cutoff_Rank": "rank",
    "Year": "year",
    "Base_Category": "base_category",
    "Quota": "quota",
    "Region": "region",
}

COMEDK_NAMES = {
    "College Code": "college_code",
    "College Name": "college_name",
    "Seat Category": "category",
    "Branch Name": "course_name",
    "Cutoff Rank": "rank",
}

COMEDK_CLEAN = (
    "college_code STRING, college_name STRING, category STRING, course_name STRING, "
    "rank DOUBLE, year INT"
)
