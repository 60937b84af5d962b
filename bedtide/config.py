"""Fixed values shared by every stage. They define the data contract, so they are stated as plain text."""

from __future__ import annotations

# --- fixed values: departments, labels, default capacities ---------------------------------
DEPARTMENTS = ("icu", "ward", "emergency", "pediatric")
DEPARTMENT_LABELS = {
    "icu": "ICU",
    "ward": "General Ward",
    "emergency": "Emergency",
    "pediatric": "Pediatric",
}
DEFAULT_CAPACITIES = {"icu": 48, "ward": 260, "emergency": 72, "pediatric": 45}

# --- fixed values: limits and defaults -----------------------------------------------------
MIN_SERIES_ROWS = 120
HORIZON_MIN, HORIZON_MAX, HORIZON_DEFAULT = 6, 168, 48
HISTORY_MIN, HISTORY_MAX, HISTORY_DEFAULT = 24, 336, 168
ALERT_LIMIT_MIN, ALERT_LIMIT_MAX, ALERT_LIMIT_DEFAULT = 1, 200, 50
THRESHOLD_MIN, THRESHOLD_MAX, THRESHOLD_DEFAULT = 0.5, 1.0, 0.9
CRITICAL_MARGIN = 0.07
CAPACITY_BUFFER = 1.12
CAPACITY_STEP = 5
DAILY_FLOW_DAYS = 21
DEFAULT_STAY_HOURS, MIN_STAY_HOURS = 36.0, 12.0
BAND_Z = 1.96
RMSE_FLOOR = 1.5
DATASET_NAME_LENGTH = (3, 120)
CSV_TEXT_MIN_LENGTH = 20

# --- fixed values: scenario bounds ---------------------------------------------------------
SCENARIO_BOUNDS = {
    "admissions_multiplier": (0.2, 5.0),
    "discharges_multiplier": (0.2, 5.0),
    "emergency_multiplier": (0.2, 5.0),
    "outbreak_delta": (-1.0, 1.0),
    "occupancy_delta": (-100.0, 100.0),
    "duration_hours": (6, 168),
}
SCENARIO_NAME_LENGTH = (3, 80)
SCENARIO_DESCRIPTION_MAX = 240

# --- fixed values: accepted column headers, first listed header present wins ----------------
READING_ALIASES = {
    "timestamp": ["timestamp", "datetime", "date_time", "recorded_at", "date", "hour"],
    "admissions": ["admissions", "admission_count", "admit_count", "admitted"],
    "discharges": ["discharges", "discharge_count", "released_count", "released"],
    "emergency_cases": ["emergency_cases", "emergency_admissions", "er_cases", "ed_cases"],
    "outbreak_signal": ["outbreak_signal", "outbreak_index", "surge_signal"],
    "icu_occupied": ["icu_occupied", "icu_beds_occupied", "icu_occupancy"],
    "ward_occupied": ["ward_occupied", "ward_beds_occupied", "general_ward_occupancy"],
    "emergency_occupied": ["emergency_occupied", "emergency_beds_occupied", "emergency_occupancy"],
    "pediatric_occupied": ["pediatric_occupied", "pediatric_beds_occupied", "pediatric_occupancy"],
}
ENCOUNTER_ALIASES = {
    "patient_id": ["patient_id", "encounter_id", "visit_id"],
    "admission_time": ["admission_time", "admit_time", "admitted_at", "admission_datetime"],
    "discharge_time": ["discharge_time", "discharged_at", "departure_time", "discharge_datetime"],
    "department": ["department", "unit", "ward", "bed_type", "care_unit"],
    "admission_type": ["admission_type", "visit_type", "source", "encounter_type"],
}

# --- fixed values: department keywords and urgency patterns ----------------------------------
PEDIATRIC_WORDS = "pediatric|paediatric|child|nicu|picu"
EMERGENCY_WORDS = "emergency|trauma|casualty"
EMERGENCY_SHORT = "(^|[^a-z])(er|ed)([^a-z]|$)"
ICU_WORDS = "icu|intensive|critical"
URGENCY_PATTERNS = {
    "reference": "emerg|urgent|trauma|er|ed",
    "word": r"emerg|urgent|trauma|\b(er|ed)\b",
}
DEFAULT_DEPARTMENT_TEXT = "general ward"

# --- fixed values: model features and learner settings ---------------------------------------
CALENDAR_FEATURES = ["hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
EXOGENOUS = ["admissions", "discharges", "emergency_cases", "outbreak_signal"]
TARGET_LAGS = [1, 2, 6, 24, 48, 72]
TARGET_WINDOWS = [6, 24, 72]
EXOGENOUS_WINDOW = 24
TRAIN_SHARE = 0.85
LEARNER = {"maxIter": 150, "maxDepth": 6, "stepSize": 0.08, "maxBins": 255, "minInstancesPerNode": 20, "seed": 42}

# --- names derived from the above -------------------------------------------------------------
OCCUPANCY_COLUMNS = [f"{d}_occupied" for d in DEPARTMENTS]
LAG_FEATURES = [f"lag_{k}" for k in TARGET_LAGS]
ROLLING_FEATURES = [f"rolling_mean_{w}" for w in TARGET_WINDOWS]
EXOGENOUS_ROLLING_FEATURES = ["admissions_rolling_24", "discharges_rolling_24", "emergency_rolling_24"]
FEATURES = CALENDAR_FEATURES + EXOGENOUS + LAG_FEATURES + ROLLING_FEATURES + EXOGENOUS_ROLLING_FEATURES
# What a pooled model knows of the facility: beds, and mean and deviation of the share in use while training.
SERIES_FEATURES = ["capacity_beds", "usual_share", "share_deviation"]
MODEL_FEATURES = FEATURES + SERIES_FEATURES

DEFAULT_FACILITY = "f0"
BASELINE_SCENARIO = 0
