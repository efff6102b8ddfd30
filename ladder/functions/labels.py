"""Fixed code -> label dictionaries and category orders.

These values must equal the reference's for identical output, so they are stated verbatim.
"""

# --- Fixed values (must equal the reference) -------------------------------------------------

EDU_LABELS = {
    "elementary": "초졸 이하",
    "middle_school": "중졸",
    "high_school": "고졸",
    "college": "전문대졸",
    "university": "대졸",
    "graduate_school": "대학원졸",
}
EDU_ORDER = ["elementary", "middle_school", "high_school", "college", "university", "graduate_school"]

PARENT_EDU_LABELS = {
    1: "중졸 이하",
    2: "고졸",
    3: "전문대졸",
    4: "전문학사",
    5: "대졸",
    6: "석사+",
}

EMPLOYMENT_TYPE_LABELS = {
    1: "정규직/상용",
    2: "비정규직",
    3: "기타",
}

FIRM_SIZE_LABELS = {
    1: "10명 미만",
    2: "10~29명",
    3: "30~99명",
    4: "100~299명",
    5: "300~499명",
    6: "500명 이상",
}

JOB_STATUS_LABELS = {
    1: "상용직",
    2: "임시직",
    3: "일용직",
    4: "고용주/자영업자",
    5: "무급가족",
}

MOBILITY_LABELS = {
    "upward": "상승",
    "stable": "유지",
    "downward": "하락",
}
MOBILITY_ORDER = ["upward", "stable", "downward"]

GENERATION_LABELS = {
    "young": "청년층",
    "middle": "중장년층",
    "senior": "고령층",
}
GENERATION_ORDER = ["young", "middle", "senior"]

# Cohort tags derived from the first digit of a student id, and the "other" tag.
COHORT_FIRST = "KEEP I"
COHORT_SECOND = "KEEP II"
COHORT_OTHER = "기타"

# Tier names and the employment-rate cut that separates them.
HIGH_TIER = "High_Tier"
NORMAL_TIER = "Normal_Tier"
TIER_CUT = 68.0

# Mobility thresholds on the income decile: "lower" is <= 3, "upper" is >= 8.
LOWER_MAX_DECILE = 3
UPPER_MIN_DECILE = 8

# --- end of fixed values ---------------------------------------------------------------------
