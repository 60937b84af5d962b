"""The registered queries restated as SQL over the same tables, in its own formulation: generated hour
spines and left joins where the library fills gaps, ``median`` where it refines histograms."""

from __future__ import annotations

import math

from bedtide import config as C

HOUR_US = 3_600_000_000
D = list(C.DEPARTMENTS)
OCC = C.OCCUPANCY_COLUMNS
HORIZON, OVERRIDE = 48, 0.6
NOW = {n: f"2024-03-0{n}T08:00:00" for n in (1, 2, 3, 4)}


def r(expr: str, digits: int) -> str:
    """Round the binary value, ties to even, as printing with a fixed number of digits does."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


def real(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def commas(items) -> str:
    return ", ".join(items)


def case(column: str, pairs, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + f" ELSE {default} END"


LABEL = case("department", [(f"'{k}'", f"'{v}'") for k, v in C.DEPARTMENT_LABELS.items()])
ORDER = case("department", [(f"'{d}'", str(i)) for i, d in enumerate(D)])

# --- encounters ------------------------------------------------------------------------------------------
EVENT_ENCOUNTERS = """
enc AS (
  SELECT CAST(user_id % 4 AS VARCHAR) AS facility_id, CAST(event_id AS VARCHAR) AS patient_id,
    ts AS admission_time,
    CASE WHEN event_id % 17 = 0 THEN NULL
         WHEN event_id % 23 = 0 THEN ts - INTERVAL 5 HOUR
         ELSE ts + to_microseconds(CAST(round(value * 3600) AS BIGINT) * 1000000) END AS discharge_time,
    CASE event_type WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'Emergency Department'
      WHEN 'view' THEN 'Pediatric Ward' WHEN 'signup' THEN 'Trauma ED'
      WHEN 'purchase' THEN 'General Ward' ELSE 'general ward' END AS department,
    CASE event_id % 4 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Scheduled' WHEN 2 THEN 'Direct' ELSE 'Walk-in' END
      AS admission_type
  FROM events)"""

ORDER_ENCOUNTERS = """
enc AS (
  SELECT CAST(l_suppkey % 8 AS VARCHAR) AS facility_id, l_orderkey || '-' || l_linenumber AS patient_id,
    o_orderdate AS admission_time, l_shipdate AS discharge_time,
    CASE o_orderstatus WHEN 'F' THEN 'ICU' WHEN 'O' THEN 'General Ward' WHEN 'P' THEN 'Child Health'
      ELSE 'general ward' END AS department,
    o_orderpriority AS admission_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def mapping(department: str, kind: str) -> str:
    words = f"regexp_replace(lower(trim({department} || ' ' || {kind})), '[^a-z]+', ' ', 'g')"
    has = lambda listed: "(" + " OR ".join(f"contains({words}, '{w}')" for w in listed.split("|")) + ")"
    return (
        f"CASE WHEN {has(C.PEDIATRIC_WORDS)} THEN 'pediatric' "
        f"WHEN {has(C.EMERGENCY_WORDS)} OR regexp_matches({words}, '\\b(er|ed)\\b') THEN 'emergency' "
        f"WHEN {has(C.ICU_WORDS)} THEN 'icu' ELSE 'ward' END"
    )


def urgent(kind: str, urgency: str = "reference") -> str:
    return f"regexp_matches({kind}, '{C.URGENCY_PATTERNS[urgency]}', 'i')"


def cleaning(urgency: str = "reference") -> str:
    return f"""
los AS (SELECT facility_id, epoch_us(discharge_time) - epoch_us(admission_time) AS los FROM enc
        WHERE discharge_time IS NOT NULL AND admission_time IS NOT NULL),
stay AS (SELECT facility_id, greatest({C.MIN_STAY_HOURS * HOUR_US:.0f},
           CASE WHEN count(*) FILTER (WHERE los <> 0) > 0 THEN median(los) ELSE {C.DEFAULT_STAY_HOURS * HOUR_US:.0f} END) AS us
         FROM los GROUP BY facility_id),
fixed AS (SELECT enc.* EXCLUDE (discharge_time),
            (discharge_time IS NULL OR discharge_time <= admission_time) AS discharge_imputed,
            CASE WHEN discharge_time IS NULL OR discharge_time <= admission_time
                 THEN admission_time + to_microseconds(CAST(ceil(us) AS BIGINT)) ELSE discharge_time END AS discharge_time,
            {mapping('department', 'admission_type')} AS mapped_department
          FROM enc JOIN stay USING (facility_id) WHERE admission_time IS NOT NULL),
clean AS (SELECT *, date_trunc('hour', admission_time) AS ab,
            greatest(date_trunc('hour', admission_time) + INTERVAL 1 HOUR,
                     date_trunc('hour', discharge_time + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)) AS db,
            (mapped_department = 'emergency' OR {urgent('admission_type', urgency)}) AS is_emergency
          FROM fixed)"""


# --- the hourly fact ----------------------------------------------------------------------------------------
SPINE = f"""
bounds AS (SELECT facility_id, min(ab) AS lo, max(db) AS hi FROM clean GROUP BY facility_id),
spine AS (SELECT facility_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
ins AS (SELECT facility_id, ab AS ts, count(*) AS admissions, count(*) FILTER (WHERE is_emergency) AS emergency_cases,
          {commas(f"count(*) FILTER (WHERE mapped_department = '{d}') AS {d}_in" for d in D)}
        FROM clean GROUP BY facility_id, ab),
outs AS (SELECT facility_id, db AS ts, count(*) AS discharges,
          {commas(f"count(*) FILTER (WHERE mapped_department = '{d}') AS {d}_out" for d in D)}
        FROM clean GROUP BY facility_id, db),
occupancy AS (
  SELECT facility_id, ts, CAST(coalesce(admissions, 0) AS BIGINT) AS admissions,
    CAST(coalesce(discharges, 0) AS BIGINT) AS discharges, CAST(coalesce(emergency_cases, 0) AS BIGINT) AS emergency_cases,
    {commas(f"CAST(sum(coalesce({d}_in, 0) - coalesce({d}_out, 0)) OVER w AS DOUBLE) AS {d}_occupied" for d in D)}
  FROM spine LEFT JOIN ins USING (facility_id, ts) LEFT JOIN outs USING (facility_id, ts)
  WINDOW w AS (PARTITION BY facility_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
total AS (SELECT *, {' + '.join(OCC)} AS total_occupied FROM occupancy)"""


def signal(source: str, target: str) -> str:
    score = lambda c: (
        f"greatest(0.0, ({c} - coalesce(CASE WHEN count({c}) OVER week >= 24 THEN avg({c}) OVER week END, avg({c}) OVER sofar)) / "
        f"coalesce(nullif(CASE WHEN count({c}) OVER week >= 24 THEN stddev_samp({c}) OVER week END, 0), "
        f"nullif(stddev_samp({c}) OVER (PARTITION BY facility_id), 0), 1))"
    )
    return f"""
scored AS (SELECT *, {real(0.7)} * {score('admissions')} + {real(0.3)} * {score('emergency_cases')} AS combined
  FROM {source}
  WINDOW week AS (PARTITION BY facility_id ORDER BY ts ROWS 167 PRECEDING),
         sofar AS (PARTITION BY facility_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
{target} AS (SELECT * EXCLUDE (combined),
  least(1.0, greatest(0.0, coalesce(combined / greatest(max(combined) OVER (PARTITION BY facility_id), 1.0), 0.0))) AS outbreak_signal
  FROM scored)"""


def capacity(peak: str, default: int) -> str:
    return f"greatest(5, CAST(ceil(greatest({default}, coalesce({peak}, 0) * {real(C.CAPACITY_BUFFER)}) / 5.0e0) AS INTEGER) * 5)"


CAPACITY = f"""
caps AS (SELECT facility_id, {commas(f"{capacity(f'max({d}_occupied)', C.DEFAULT_CAPACITIES[d])} AS {d}" for d in D)}
         FROM total GROUP BY facility_id),
cap AS ({' UNION ALL '.join(f"SELECT facility_id, '{d}' AS department, {d} AS capacity FROM caps" for d in D)})"""

LONG = f"""
long AS ({' UNION ALL '.join(f"SELECT facility_id, ts, '{d}' AS department, {d}_occupied AS occupied FROM total" for d in D)})"""

BASE = "WITH " + EVENT_ENCOUNTERS + "," + cleaning() + "," + SPINE + "," + CAPACITY + "," + LONG
FACT = BASE + "," + signal("total", "fact")
# The series up to the last hour with an admission; everything after ``total`` then works on that.
CUT_TOTAL = """,
total AS (SELECT * EXCLUDE (last) FROM whole JOIN (SELECT facility_id, max(ts) FILTER (WHERE admissions > 0) AS last FROM whole GROUP BY facility_id)
          USING (facility_id) WHERE ts <= last)"""
CUT_BASE = "WITH " + EVENT_ENCOUNTERS + "," + cleaning() + "," + SPINE.replace("total AS (", "whole AS (") + CUT_TOTAL + "," + CAPACITY
VOLUME = "WITH " + ORDER_ENCOUNTERS + "," + cleaning() + "," + SPINE + "," + LONG
WORD = "WITH " + EVENT_ENCOUNTERS + "," + cleaning("word") + "," + SPINE

ORACLE: dict[str, str] = {}
add = ORACLE.__setitem__

micro = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
add("encounters_clean", BASE + f"""
SELECT facility_id, patient_id, {micro('admission_time')} AS admission_time, {micro('discharge_time')} AS discharge_time,
  department, admission_type, mapped_department, CAST(discharge_imputed AS BIGINT) AS discharge_imputed,
  {iso('ab')} AS admission_bucket, {iso('db')} AS discharge_bucket, CAST(is_emergency AS BIGINT) AS is_emergency FROM clean""")

# --- text files ------------------------------------------------------------------------------------------------
shown = lambda c: f"date_trunc(CASE facility_id WHEN '1' THEN 'second' ELSE 'minute' END, {c})"
add("time_formats", "WITH " + EVENT_ENCOUNTERS + f"""
SELECT facility_id, patient_id, {iso(shown('admission_time'))} AS admission_time, {iso(shown('discharge_time'))} AS discharge_time,
  department, admission_type FROM enc""")

add("time_votes", "WITH " + EVENT_ENCOUNTERS + """,
times AS (SELECT facility_id, 'Admission Time' AS "column", admission_time AS t FROM enc
          UNION ALL SELECT facility_id, 'Departure-Time', discharge_time FROM enc WHERE discharge_time IS NOT NULL),
parsed AS (
  SELECT facility_id, "column", CASE facility_id WHEN '0' THEN 'month_first' WHEN '1' THEN 'day_first' WHEN '2' THEN 'year_first' ELSE 'month_name' END AS layout,
    count(*) AS parsed FROM times GROUP BY ALL
  UNION ALL
  SELECT facility_id, "column", CASE facility_id WHEN '0' THEN 'day_first' ELSE 'month_first' END, count(*)
  FROM times WHERE facility_id IN ('0', '1') AND day(t) <= 12 GROUP BY ALL)
SELECT facility_id, "column", layout, parsed,
  CAST(row_number() OVER (PARTITION BY facility_id, "column" ORDER BY parsed DESC, layout = 'day_first') = 1 AS BIGINT) AS chosen FROM parsed""")

as_text = lambda c: f"""CASE facility_id WHEN '0' THEN strftime({c}, '%m/%d/%Y %H:%M') WHEN '1' THEN strftime({c}, '%d/%m/%Y %H:%M:%S')
  WHEN '2' THEN strftime({c}, '%Y/%m/%d %H:%M') ELSE strftime({c}, '%b %-d, %Y %-I:%M %p') END"""
SPOILED = EVENT_ENCOUNTERS + f""",
written AS (
  SELECT facility_id, patient_id, department, admission_type, discharge_time,
    CASE WHEN n % 19 = 0 THEN 'n/a' WHEN n % 29 = 0 THEN '31/31/2024 99:00' WHEN n % 37 = 0 THEN NULL WHEN n % 31 = 0 AND facility_id = '0' THEN '25/12/2024 10:00'
      ELSE {as_text('admission_time')} END AS admission,
    CASE WHEN n % 19 = 0 OR n % 29 = 0 THEN 'unreadable' WHEN n % 37 = 0 THEN 'missing' WHEN n % 31 = 0 AND facility_id = '0' THEN 'other layout' END AS fault,
    {as_text('discharge_time')} AS departure
  FROM (SELECT *, CAST(patient_id AS BIGINT) AS n FROM enc))"""
source_department = """CASE event_type WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'Emergency Department'
  WHEN 'view' THEN 'Pediatric Ward' WHEN 'signup' THEN 'Trauma ED' WHEN 'purchase' THEN 'General Ward' END"""
entry = lambda header, c: f"""CASE WHEN {c} IS NULL THEN '' ELSE ',"{header}":' || to_json({c}) END"""
add("rejected_rows", "WITH " + SPOILED + f""",
kinds AS (SELECT CAST(event_id AS VARCHAR) AS patient_id, {source_department} AS unit FROM events)
SELECT 1 AS has_file, 'admission_time: ' || fault AS reason,
  '{{"Encounter ID":"' || patient_id || '"' || {entry('Admission Time', 'admission')} || {entry('Departure-Time', 'departure')}
    || {entry('Care Unit', 'unit')} || ',"Visit Type":"' || admission_type || '","facility_id":"' || facility_id || '"}}' AS record
FROM written JOIN kinds USING (patient_id) WHERE fault IS NOT NULL""")

add("ingest_report", "WITH " + SPOILED + """
SELECT count(*) FILTER (fault IS NULL) AS readable, count(discharge_time) FILTER (fault IS NULL) AS discharges, count(*) AS rows, count(fault) AS rejected,
  count(*) FILTER (fault = 'missing') AS missing, count(*) FILTER (fault = 'other layout') AS other_layout, count(*) FILTER (fault = 'unreadable') AS unreadable,
  count(*) FILTER (fault IS NULL AND departure IS NULL) AS discharge_missing, 0 AS discharge_other_layout, 0 AS discharge_unreadable FROM written""")

for name, source in [("department_mapping", EVENT_ENCOUNTERS), ("department_mapping_orders", ORDER_ENCOUNTERS)]:
    add(name, "WITH " + source + f""",
mapped AS (SELECT department, admission_type, {mapping('department', 'admission_type')} AS mapped_department FROM enc)
SELECT department, admission_type, count(*) AS encounters, mapped_department,
  CAST(mapped_department = 'emergency' OR {urgent('admission_type')} AS BIGINT) AS is_emergency,
  CAST(mapped_department = 'emergency' OR {urgent('admission_type', 'word')} AS BIGINT) AS is_emergency_by_word
FROM mapped GROUP BY ALL""")

for name, prelude in [("default_stay", BASE), ("default_stay_orders", VOLUME)]:
    add(name, prelude + f" SELECT facility_id, us / CAST({HOUR_US} AS DOUBLE) AS default_stay_hours FROM stay")

FLOW = f" SELECT facility_id, {iso('ts')} AS ts, admissions, discharges, emergency_cases FROM total"
LONG_OUT = f" SELECT facility_id, {iso('ts')} AS ts, department, occupied FROM long"
add("hourly_flow", BASE + FLOW)
add("hourly_flow_word_urgency", WORD + FLOW)
add("hourly_occupancy", BASE + LONG_OUT)
add("hourly_total", BASE + f" SELECT facility_id, {iso('ts')} AS ts, {commas(OCC)}, total_occupied FROM total")
add("occupancy_by_overlap", BASE + f"""
SELECT s.facility_id, c.mapped_department AS department, {iso('s.ts')} AS ts, CAST(count(*) AS DOUBLE) AS occupied
FROM spine s JOIN clean c ON s.facility_id = c.facility_id AND c.ab <= s.ts AND s.ts < c.db GROUP BY ALL""")
add("occupancy_by_range_join", ORACLE["occupancy_by_overlap"])
add("occupancy_by_range_join_volume", VOLUME + LONG_OUT + " WHERE occupied > 0")
STRAYS = EVENT_ENCOUNTERS.replace("enc AS (", "plain AS (", 1) + """,
strays AS (SELECT * REPLACE (
    CASE WHEN CAST(patient_id AS BIGINT) % 251 = 0 THEN TIMESTAMP '0202-01-02 03:00:00' WHEN CAST(patient_id AS BIGINT) % 241 = 0 THEN TIMESTAMP '9998-06-01 05:00:00' ELSE admission_time END AS admission_time,
    CASE WHEN CAST(patient_id AS BIGINT) % 41 = 0 THEN TIMESTAMP '9999-12-31 00:00:00' ELSE discharge_time END AS discharge_time) FROM plain),
days AS (SELECT facility_id, CAST(admission_time AS DATE) AS day, count(*) AS n FROM strays GROUP BY ALL),
opened AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY facility_id ORDER BY day) <= 366 THEN 0 ELSE 1 END AS opens FROM days),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY facility_id ORDER BY day) AS run FROM opened),
sizes AS (SELECT facility_id, run, sum(n) AS n, min(day) AS first_day, max(day) AS last_day FROM runs GROUP BY ALL),
spans AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY n DESC, last_day DESC) = 1),
judged AS (SELECT strays.*, CASE WHEN CAST(admission_time AS DATE) NOT BETWEEN first_day AND last_day THEN 'admission outside span'
    WHEN CAST(discharge_time AS DATE) > last_day + 366 THEN 'discharge outside span' END AS issue FROM strays JOIN spans USING (facility_id))"""
add("robust_hours", "WITH " + STRAYS + """,
enc AS (SELECT * EXCLUDE (issue) REPLACE (CASE WHEN issue IS NULL THEN discharge_time END AS discharge_time) FROM judged WHERE issue IS NULL OR issue LIKE 'discharge%')""" + "," + cleaning() + "," + SPINE + "," + LONG + LONG_OUT)
add("span_issues", "WITH " + STRAYS + f"""
SELECT facility_id, issue, count(*) AS rows, {iso("min(CASE WHEN issue LIKE 'ad%' THEN admission_time ELSE discharge_time END)")} AS first_time,
  {iso("max(CASE WHEN issue LIKE 'ad%' THEN admission_time ELSE discharge_time END)")} AS last_time FROM judged WHERE issue IS NOT NULL GROUP BY ALL""")
add("default_stay_sketch", "WITH " + EVENT_ENCOUNTERS + f"""
SELECT facility_id, round(median(epoch_us(discharge_time) - epoch_us(admission_time)) / {HOUR_US}.0e0, 6) AS median_hours, count(*) AS rows, 1 AS is_close
FROM enc WHERE discharge_time IS NOT NULL GROUP BY facility_id""")
add("hourly_occupancy_volume", VOLUME + LONG_OUT)
add("hourly_flow_volume", VOLUME + FLOW)
add("outbreak_signal", FACT + f" SELECT facility_id, {iso('ts')} AS ts, round(outbreak_signal, 6) AS outbreak_signal FROM fact")

# --- readings --------------------------------------------------------------------------------------------------
READINGS = f"""WITH
reading AS (SELECT CAST(user_id % 32 AS VARCHAR) AS facility_id, date_trunc('hour', ts) AS ts,
  CAST(event_id % 3 AS DOUBLE) AS admissions, CAST(event_id % 2 AS DOUBLE) AS discharges,
  CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END AS emergency_cases, value AS icu, value / 2 AS ward,
  value / 4 AS emergency, value / 8 AS pediatric FROM events WHERE ts IS NOT NULL),
per_hour AS (SELECT facility_id, ts, sum(admissions) AS admissions, sum(discharges) AS discharges,
  sum(emergency_cases) AS emergency_cases, {commas(f"avg({d}) AS {d}_occupied" for d in D)} FROM reading GROUP BY ALL),
span AS (SELECT facility_id, min(ts) AS lo, max(ts) AS hi FROM per_hour GROUP BY facility_id),
hours AS (SELECT facility_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
gapless AS (SELECT facility_id, ts, coalesce(admissions, 0) AS admissions, coalesce(discharges, 0) AS discharges,
  coalesce(emergency_cases, 0) AS emergency_cases, {commas(OCC)}, p.icu_occupied IS NOT NULL AS seen
  FROM hours LEFT JOIN per_hour p USING (facility_id, ts)),""" + signal("gapless", "fact")
for name, given in [("hourly_readings", "CASE WHEN seen THEN 0.0 ELSE outbreak_signal END"), ("hourly_readings_derived", "outbreak_signal")]:
    add(name, READINGS + f"""
SELECT facility_id, {iso('ts')} AS ts, admissions, discharges, emergency_cases, round({given} + 1e-9, 6) AS outbreak_signal,
  {commas(f"round({c} + 1e-9, 6) AS {c}" for c in OCC)}, round({' + '.join(f"coalesce({c}, 0)" for c in OCC)} + 1e-9, 6) AS total_occupied
FROM fact""")

# --- capacities and metadata ---------------------------------------------------------------------------------------
META = f""",
meta AS (SELECT facility_id, count(*) AS rows, {iso('min(ts)')} AS coverage_start, {iso('max(ts)')} AS coverage_end
         FROM total GROUP BY facility_id)"""
add("capacities", BASE + " SELECT facility_id, department, capacity FROM cap")
add("dataset_metadata", BASE + META + f"""
SELECT facility_id, 'events' AS source_name, 'event_level_his' AS source_type, rows, coverage_start, coverage_end,
  {commas(f"{d} AS capacity_{d}" for d in D)} FROM meta JOIN caps USING (facility_id)""")
add("manifest", BASE + META + f""",
source AS (SELECT facility_id, count(*) AS source_rows FROM enc GROUP BY facility_id)
SELECT facility_id, source_rows, rows AS hourly_rows,
  '{{"profile":"Facility ' || facility_id || '","rows":' || source_rows || ',"hourly_rows":' || rows ||
  ',"metadata":{{"source_name":"events","source_type":"event_level_his","rows":' || rows ||
  ',"coverage_start":"' || coverage_start || '","coverage_end":"' || coverage_end || '","capacities":{{' ||
  {" || ',' || ".join(f"'{chr(34)}{d}{chr(34)}:' || {d}" for d in D)} || '}}}}}}' AS manifest
FROM meta JOIN caps USING (facility_id) JOIN source USING (facility_id)""")
add("series_lengths", BASE + META + f" SELECT facility_id, rows, CAST(rows < {C.MIN_SERIES_ROWS} AS BIGINT) AS is_short FROM meta")
add("display_lines", BASE + f"""
SELECT facility_id, department, CAST(floor(capacity * {real(0.9)} + 0.5) AS INTEGER) AS threshold_line,
  {" || ' | ' || ".join(f"'{d}: ' || {d}" for d in D)} AS capacity_line FROM cap JOIN caps USING (facility_id)""")

# --- overview and trends ----------------------------------------------------------------------------------------------
CUT = """,
cut AS (SELECT * FROM fact JOIN (SELECT facility_id, max(ts) FILTER (WHERE admissions > 0) AS last FROM fact GROUP BY facility_id)
        USING (facility_id) WHERE ts <= last)"""


def overview(source: str) -> str:
    peaks = commas(f"{capacity(f'max({d}_occupied)', C.DEFAULT_CAPACITIES[d])} AS {d}" for d in D)
    return f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC) AS back,
             count(*) OVER (PARTITION BY facility_id) AS n FROM {source}),
now_row AS (SELECT * FROM ranked WHERE back = 1),
old_row AS (SELECT * FROM ranked WHERE back = CASE WHEN n > 25 THEN 25 ELSE n END),
ocap AS (SELECT facility_id, {peaks} FROM {source} GROUP BY facility_id)"""


def overview_departments(source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT facility_id, '{d}' AS department, ocap.{d} AS capacity, now_row.{d}_occupied AS occ, old_row.{d}_occupied AS old "
        "FROM now_row JOIN old_row USING (facility_id) JOIN ocap USING (facility_id)" for d in D
    )
    return overview(source) + f""", listed AS ({rows})
SELECT facility_id, department, {LABEL} AS label, capacity, {r('occ', 1)} AS occupied, {r('capacity - occ', 1)} AS available,
  {r('occ / capacity', 3)} AS utilization, {r('occ - old', 1)} AS delta_24h,
  CAST({r('occ / capacity', 3)} >= {real(0.9)} AS BIGINT) AS is_critical FROM listed"""


def overview_hospital(source: str) -> str:
    beds, occupied = " + ".join(f"ocap.{d}" for d in D), " + ".join(f"now_row.{d}_occupied" for d in D)
    return overview(source) + f"""
SELECT facility_id, {beds} AS total_capacity, {r(occupied, 1)} AS occupied, {r(f'({beds}) - ({occupied})', 1)} AS available,
  {r(f'({occupied}) / ({beds})', 3)} AS utilization FROM now_row JOIN ocap USING (facility_id)"""


add("overview_departments", FACT + overview_departments("fact"))
add("overview_departments_as_of", FACT + CUT + overview_departments("cut"))
add("overview_hospital", FACT + overview_hospital("fact"))
add("overview_hospital_as_of", FACT + CUT + overview_hospital("cut"))
add("overview_rollup", BASE + f""",
newest AS (SELECT facility_id, department, arg_max(occupied, ts) AS beds FROM long GROUP BY ALL)
SELECT CASE WHEN grouping(facility_id) = 1 THEN 'network' WHEN grouping(department) = 1 THEN 'facility' ELSE 'department' END AS level,
  facility_id, department, count(*) AS series, CAST(sum(capacity) AS BIGINT) AS capacity, {r('sum(beds)', 1)} AS occupied, {r('sum(capacity) - sum(beds)', 1)} AS available,
  {r('sum(beds) / sum(capacity)', 3)} AS utilization
FROM newest JOIN cap USING (facility_id, department) GROUP BY GROUPING SETS ((facility_id, department), (facility_id), ())""")
add("overview_analytics", FACT + f""",
by_hour AS (SELECT facility_id, hour(ts) AS h, avg(admissions) AS m FROM fact GROUP BY ALL),
by_day AS (SELECT facility_id, dayname(ts) AS d, avg(admissions) AS m FROM fact GROUP BY ALL),
top_hour AS (SELECT facility_id, h FROM by_hour QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY m DESC, h) = 1),
top_day AS (SELECT facility_id, d FROM by_day QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY m DESC, d) = 1),
means AS (SELECT facility_id, avg(ward_occupied) AS ward, avg(discharges) AS out, avg(total_occupied) AS occ, avg(admissions) AS adm
          FROM fact GROUP BY facility_id),
last_row AS (SELECT facility_id, arg_max(outbreak_signal, ts) AS s FROM fact GROUP BY facility_id)
SELECT facility_id, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS peak_admission_hour, d AS busiest_day,
  greatest(8.0, {r('ward / greatest(out, 1.0) * 24', 1)}) AS average_length_of_stay_hours,
  {r('s', 3)} AS outbreak_pressure_index, {r('occ / adm', 1)} AS little_law_hours
FROM top_hour JOIN top_day USING (facility_id) JOIN means USING (facility_id) JOIN last_row USING (facility_id)""")

HISTORY = f""",
recent AS (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts) - 1 AS position FROM (
  SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC) <= {C.HISTORY_DEFAULT}))
SELECT facility_id, position, {iso('ts')} AS timestamp, {commas(f"{r(f'{d}_occupied', 1)} AS {d}" for d in D)} FROM recent"""
add("occupancy_history", FACT + HISTORY)
add("occupancy_history_downsampled", FACT + HISTORY + " WHERE position % 3 = 0")
add("daily_flow", FACT + f""",
daily AS (SELECT facility_id, strftime(ts, '%Y-%m-%d') AS date, {commas(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in C.EXOGENOUS[:3])}
          FROM fact GROUP BY ALL)
SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY date DESC) <= {C.DAILY_FLOW_DAYS}""")

# --- features -----------------------------------------------------------------------------------------------------------
TAU = real(2 * math.pi)


def calendar(ts: str = "ts") -> str:
    hour, dow = f"hour({ts})", f"(isodow({ts}) - 1)"
    angle = lambda f, x, n: f"round({f}({TAU} * {x} / {n}), 6) + 0.0"
    return (
        f"{hour} AS hour, {dow} AS day_of_week, month({ts}) AS month, CAST({dow} >= 5 AS BIGINT) AS is_weekend, "
        f"{angle('sin', hour, 24)} AS hour_sin, {angle('cos', hour, 24)} AS hour_cos, "
        f"{angle('sin', dow, 7)} AS dow_sin, {angle('cos', dow, 7)} AS dow_cos"
    )


add("calendar_features", BASE + f" SELECT facility_id, {iso('ts')} AS ts, {calendar()} FROM total")

LAGS = commas(f"lag(occupied, {k}) OVER w AS lag_{k}" for k in C.TARGET_LAGS)
MEANS = commas(
    f"CASE WHEN count(occupied) OVER m{w} = {w} THEN avg(occupied) OVER m{w} END AS rolling_mean_{w}" for w in C.TARGET_WINDOWS
)
FLOW_MEANS = commas(
    f"CASE WHEN count({c}) OVER m24 = 24 THEN avg({c}) OVER m24 END AS {n}"
    for c, n in zip(C.EXOGENOUS[:3], C.EXOGENOUS_ROLLING_FEATURES)
)
OWN = C.LAG_FEATURES + C.ROLLING_FEATURES + C.EXOGENOUS_ROLLING_FEATURES
TRAINING = FACT + f""",
feature AS (SELECT facility_id, ts, department, occupied AS target, {commas(C.EXOGENOUS)}, {LAGS}, {MEANS}, {FLOW_MEANS}
  FROM long JOIN fact USING (facility_id, ts)
  WINDOW w AS (PARTITION BY facility_id, department ORDER BY ts),
    {commas(f"m{w} AS (PARTITION BY facility_id, department ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in C.TARGET_WINDOWS)}),
training AS (SELECT * FROM feature WHERE {' AND '.join(f"{c} IS NOT NULL" for c in OWN)})"""
add("training_frame", TRAINING + f"""
SELECT facility_id, department, {iso('ts')} AS ts, round(target, 6) AS target, {calendar()},
  {commas(f"round({c}, 6) AS {c}" for c in C.EXOGENOUS + OWN)} FROM training""")
add("train_validation_split", TRAINING + f"""
SELECT facility_id, department, {iso('ts')} AS ts,
  CAST(row_number() OVER (PARTITION BY facility_id, department ORDER BY ts) <=
       greatest(1, floor(count(*) OVER (PARTITION BY facility_id, department) * {real(C.TRAIN_SHARE)})) AS BIGINT) AS is_train
FROM training""")
add("observed_range", TRAINING + """
SELECT facility_id, department, min(target) AS min_observed, max(target) AS max_observed, count(*) AS rows FROM training GROUP BY ALL""")

# --- profiles and the future --------------------------------------------------------------------------------------------------


def dense(source: str, columns: list[str], target: str) -> str:
    mean = lambda c: (
        f"coalesce(avg({c}), (SELECT avg({c}) FROM {source} x WHERE x.facility_id = slots.facility_id AND hour(x.ts) = slots.hour), "
        f"(SELECT avg({c}) FROM {source} x WHERE x.facility_id = slots.facility_id)) AS {c}"
    )
    return f"""
{target} AS (SELECT slots.facility_id, slots.dow, slots.hour, {commas(mean(c) for c in columns)}, count(h.ts) = 0 AS profile_fallback
  FROM (SELECT DISTINCT facility_id, d.dow, hh.hour FROM {source}, range(7) d(dow), range(24) hh(hour)) slots
  LEFT JOIN {source} h ON h.facility_id = slots.facility_id AND isodow(h.ts) - 1 = slots.dow AND hour(h.ts) = slots.hour
  GROUP BY slots.facility_id, slots.dow, slots.hour)"""


add("exogenous_profile", FACT + f"""
SELECT facility_id, isodow(ts) - 1 AS dow, hour(ts) AS hour, {commas(f"round(avg({c}), 6) AS {c}" for c in C.EXOGENOUS)}
FROM fact GROUP BY ALL""")
add("dense_profile", FACT + "," + dense("fact", C.EXOGENOUS, "slot") + f"""
SELECT facility_id, dow, hour, {commas(f"round({c}, 6) AS {c}" for c in C.EXOGENOUS)}, CAST(profile_fallback AS BIGINT) AS profile_fallback FROM slot""")

KEY_OF_EVENT = [("'error'", "1"), ("'click'", "2"), ("'view'", "3"), ("'purchase'", "4"), ("'signup'", "5")]
SCENARIOS = f""",
scenario AS (
  SELECT DISTINCT facility_id, CAST(0 AS BIGINT) AS scenario_id, 'baseline' AS name, 1.0e0 AS fa, 1.0e0 AS fd, 1.0e0 AS fe, 0.0e0 AS dout, 0.0e0 AS docc, 0 AS duration
  FROM total
  UNION ALL
  SELECT facility_id, {case('event_type', KEY_OF_EVENT)}, 'surge of ' || event_type, {real(0.8)} + (n % 50) / 100.0e0,
    {real(1.2)} - (n % 40) / 100.0e0, {real(0.5)} + (n % 30) / 10.0e0, (n % 21 - 10) / 20.0e0, CAST(n % 61 - 10 AS DOUBLE), 6 + n % 163
  FROM (SELECT CAST(user_id % 4 AS VARCHAR) AS facility_id, event_type, count(*) AS n FROM events GROUP BY ALL)),
last_hour AS (SELECT facility_id, max(ts) AS last FROM total GROUP BY facility_id)"""


def ahead(horizon: str, scenario: str = "scenario") -> str:
    return f""",
ahead AS (SELECT facility_id, scenario_id, step, last + to_hours(CAST(step AS BIGINT)) AS ts, step <= duration AS active, fa, fd, fe, dout, docc
  FROM last_hour JOIN {scenario} USING (facility_id), range(1, 169) s(step) WHERE step <= {horizon})"""


FUTURE = "," + dense("fact", C.EXOGENOUS, "slot") + f""",
projected AS (SELECT a.*, profile_fallback,
  admissions * CASE WHEN active THEN fa ELSE 1 END AS admissions, discharges * CASE WHEN active THEN fd ELSE 1 END AS discharges,
  emergency_cases * CASE WHEN active THEN fe ELSE 1 END AS emergency_cases,
  CASE WHEN active THEN greatest(0.0, least(1.0, outbreak_signal + dout)) ELSE outbreak_signal END AS outbreak_signal
  FROM ahead a JOIN slot ON slot.facility_id = a.facility_id AND slot.dow = isodow(a.ts) - 1 AND slot.hour = hour(a.ts)),
joint AS (SELECT facility_id, scenario_id, ts, admissions, discharges, emergency_cases FROM projected
  UNION ALL SELECT facility_id, scenario_id, ts, admissions, discharges, emergency_cases FROM fact JOIN scenario USING (facility_id)),
rolled AS (SELECT facility_id, scenario_id, ts,
  {commas(f"avg({c}) OVER m24 AS {n}" for c, n in zip(C.EXOGENOUS[:3], C.EXOGENOUS_ROLLING_FEATURES))} FROM joint
  WINDOW m24 AS (PARTITION BY facility_id, scenario_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""
add("future_frame", FACT + SCENARIOS + ahead(str(HORIZON)) + FUTURE + f"""
SELECT facility_id, scenario_id, step, {iso('ts')} AS ts, CAST(active AS BIGINT) AS active, round(docc, 6) AS occupancy_delta,
  CAST(profile_fallback AS BIGINT) AS profile_fallback, {calendar()},
  {commas(f"round({c}, 9) AS {c}" for c in C.EXOGENOUS[:3] + C.EXOGENOUS_ROLLING_FEATURES)}, round(outbreak_signal, 6) AS outbreak_signal
FROM projected JOIN rolled USING (facility_id, scenario_id, ts)""")

ERRORS = """,
split AS (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts) <=
  greatest(1, floor(count(*) OVER (PARTITION BY facility_id) * """ + real(C.TRAIN_SHARE) + """)) AS is_train FROM total),
early AS (SELECT * FROM split WHERE is_train),""" + dense("early", OCC, "fit") + f""",
errs AS (SELECT s.facility_id, {commas(f"sqrt(avg((s.{d}_occupied - f.{d}_occupied) * (s.{d}_occupied - f.{d}_occupied))) AS {d}" for d in D)}
  FROM split s JOIN fit f ON s.facility_id = f.facility_id AND isodow(s.ts) - 1 = f.dow AND hour(s.ts) = f.hour
  WHERE NOT s.is_train GROUP BY s.facility_id),
err AS ({' UNION ALL '.join(f"SELECT facility_id, '{d}' AS department, greatest(1.5, {d}) AS rmse FROM errs" for d in D)})"""
add("profile_errors", BASE + ERRORS + " SELECT facility_id, department, round(rmse, 6) AS rmse FROM err")


def points(horizon: str, scenario: str = "scenario") -> str:
    rows = " UNION ALL ".join(
        f"SELECT a.facility_id, scenario_id, '{d}' AS department, step, a.ts, "
        f"o.{d}_occupied + CASE WHEN active THEN docc ELSE 0 END AS predicted FROM ahead a "
        "JOIN oslot o ON o.facility_id = a.facility_id AND o.dow = isodow(a.ts) - 1 AND o.hour = hour(a.ts)" for d in D
    )
    return ahead(horizon, scenario) + "," + dense("total", OCC, "oslot") + f""",
guess AS ({rows}),
value AS (SELECT g.*, capacity, rmse, greatest(0.0, least(CAST(capacity AS DOUBLE), predicted)) AS v
  FROM guess g JOIN cap USING (facility_id, department) JOIN err USING (facility_id, department)),
points AS (SELECT facility_id, scenario_id, department, step, {iso('ts')} AS timestamp, capacity, {r('v', 1)} AS occupied,
  {r(f'greatest(0.0, v - {real(C.BAND_Z)} * rmse)', 1)} AS lower, {r(f'least(CAST(capacity AS DOUBLE), v + {real(C.BAND_Z)} * rmse)', 1)} AS upper,
  {r('v / capacity', 3)} AS utilization FROM value)"""


ALL_POINTS = BASE + SCENARIOS + ERRORS + points(str(HORIZON))
OWN_POINTS = BASE + SCENARIOS + ERRORS + points("greatest(6, least(168, duration))")
PLAIN = ",\nplain AS (SELECT * FROM scenario WHERE scenario_id = 0)"
CUT_POINTS = CUT_BASE + SCENARIOS + PLAIN + ERRORS + points(str(HORIZON), "plain")
LONG_POINTS = BASE + SCENARIOS + PLAIN + ERRORS + points("168", "plain")
add("profile_forecast", ALL_POINTS + " SELECT * FROM points")
add("gbt_checks", ALL_POINTS + """ SELECT facility_id, scenario_id, department, count(*) AS points, min(timestamp) AS first_timestamp,
  max(timestamp) AS last_timestamp, 0 AS out_of_bounds, 0 AS under_floor, CAST(max(capacity) AS BIGINT) AS capacity FROM points GROUP BY ALL""")
add("profile_forecast_own_horizon", OWN_POINTS + " SELECT * FROM points")
PEAK = """,
peak AS (SELECT *, count(*) OVER (PARTITION BY facility_id, scenario_id, department) AS n FROM points
  QUALIFY row_number() OVER (PARTITION BY facility_id, scenario_id, department ORDER BY occupied DESC, step) = 1)"""
add("forecast_summary", LONG_POINTS + PEAK + f"""
SELECT facility_id, scenario_id, department, {LABEL} AS label, capacity, n AS horizon_hours, occupied AS peak_occupancy,
  timestamp AS peak_timestamp, CASE WHEN utilization >= {real(0.9)} THEN timestamp END AS crossing_timestamp,
  CASE WHEN utilization >= {real(0.9)} THEN utilization END AS crossing_utilization, CASE WHEN utilization >= {real(0.9)} THEN occupied END AS crossing_occupied,
  CASE WHEN utilization >= {real(0.9)} THEN lower END AS crossing_lower, CASE WHEN utilization >= {real(0.9)} THEN upper END AS crossing_upper FROM peak""")
SUMMARY = f"""
SELECT facility_id, scenario_id, department, {LABEL} AS label, occupied AS peak_occupancy, timestamp AS peak_timestamp, capacity FROM peak"""
add("what_if_summary", ALL_POINTS + PEAK + SUMMARY)

# --- linear model -------------------------------------------------------------------------------------------------------------------
# Standardised normal equations, eliminated one feature at a time; the recursion carries the last hours as a list.
F_, N_ = C.FEATURES, len(C.FEATURES)
MARKED = TRAINING + f""",
marked AS (SELECT facility_id, department, {calendar().replace("round(", "(").replace(", 6) + 0.0", ")")}, {commas(f"CAST({c} AS DOUBLE) AS {c}" for c in C.EXOGENOUS + OWN)}, CAST(target AS DOUBLE) AS target,
  row_number() OVER (PARTITION BY facility_id, department ORDER BY ts) <=
    greatest(1, floor(count(*) OVER (PARTITION BY facility_id, department) * {real(C.TRAIN_SHARE)})) AS is_train FROM training)"""
ALL_ = [*F_, "target"]
add("ridge_moments", MARKED + f""",
sums AS (SELECT facility_id, department, is_train, count(*) AS n, [{commas([f"{{'one': '{c}', 'other': '', 'total': CAST(sum({c}) AS DOUBLE)}}" for c in ALL_]
  + [f"{{'one': '{a}', 'other': '{b}', 'total': CAST(sum({a} * {b}) AS DOUBLE)}}" for i, a in enumerate(ALL_) for b in ALL_[i:]])}] AS entries FROM marked GROUP BY ALL)
SELECT facility_id, department, CAST(is_train AS BIGINT) AS is_train, n, e.one AS one, e.other AS other, round(e.total / n + 1e-9, 6) AS mean
FROM (SELECT facility_id, department, is_train, n, unnest(entries) AS e FROM sums)""")


def fitted(name: str, source: str) -> str:
    """CTEs that end in ``name`` (facility_id, department, w, c): weights and constant of a fit on the rows of ``source``."""
    whole = lambda c: f"CAST({c} AS DOUBLE)"
    return f""",
{name}_sums AS (SELECT facility_id, department, [{commas(f"avg({whole(c)})" for c in F_)}] AS m, [{commas(f"var_pop({whole(c)})" for c in F_)}] AS v, avg(target) AS my,
    [{commas(f"avg({whole(c)} * {whole(c)})" for c in F_)}] AS q FROM {source} GROUP BY ALL),
{name}_scale AS (SELECT *, list_transform(range(1, {N_ + 1}), lambda i: CASE WHEN v[i] <= 1e-12 * greatest(q[i], 1.0) THEN NULL ELSE sqrt(v[i]) END) AS s FROM {name}_sums),
{name}_z AS (SELECT facility_id, department, target - my AS y, {commas(f"coalesce(({whole(c)} - m[{i}]) / s[{i}], 0.0) AS z{i}" for i, c in enumerate(F_, 1))}
  FROM {source} JOIN {name}_scale USING (facility_id, department)),
{name}_matrix AS (SELECT facility_id, department, 0 AS k, [{commas("[" + commas([f"avg(z{i} * z{j})" + (" + 1e-3" if i == j else "") for j in range(1, N_ + 1)] + [f"avg(z{i} * y)"]) + "]" for i in range(1, N_ + 1))}] AS a
  FROM {name}_z GROUP BY ALL),
{name}_steps AS (
  SELECT * FROM {name}_matrix
  UNION ALL
  SELECT facility_id, department, k + 1, list_transform(range(1, {N_ + 1}), lambda i: list_transform(range(1, {N_ + 2}), lambda j:
    CASE WHEN i = k + 1 THEN a[k + 1][j] / a[k + 1][k + 1] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END)) FROM {name}_steps WHERE k < {N_}),
{name}_weights AS (SELECT facility_id, department, m, my, list_transform(range(1, {N_ + 1}), lambda i: coalesce(a[i][{N_ + 1}] / s[i], 0.0)) AS w
  FROM {name}_steps JOIN {name}_scale USING (facility_id, department) WHERE k = {N_}),
{name} AS (SELECT facility_id, department, w, my, my - list_sum(list_transform(range(1, {N_ + 1}), lambda i: w[i] * m[i])) AS c FROM {name}_weights)"""


RIDGE = MARKED.replace("WITH ", "WITH RECURSIVE ", 1) + ",\nearly_rows AS (SELECT * FROM marked WHERE is_train)" + fitted("early_fit", "early_rows") + fitted("fit_all", "marked") + f""",
late AS (SELECT facility_id, department, sqrt(avg(pow(target - c - ({' + '.join(f'w[{i}] * {c}' for i, c in enumerate(F_, 1))}), 2))) AS error
  FROM marked JOIN early_fit USING (facility_id, department) WHERE NOT is_train GROUP BY ALL),
ridge AS (SELECT f.*, counted.rows, capacity, greatest(1.5, coalesce(error, 0.15 * spread)) AS rmse
  FROM fit_all f JOIN (SELECT facility_id, department, count(*) AS rows, stddev_samp(target) AS spread FROM marked GROUP BY ALL) counted USING (facility_id, department)
  JOIN cap USING (facility_id, department) LEFT JOIN late USING (facility_id, department))"""
add("ridge_metrics", RIDGE + " SELECT facility_id, department, round(rmse, 5) AS rmse, capacity, rows, 1 AS is_solved FROM ridge")

KNOWN = [c for c in F_ if c not in C.LAG_FEATURES + C.ROLLING_FEATURES]
at_ = lambda c: F_.index(c) + 1
RIDGE_POINTS = RIDGE + SCENARIOS + ahead(str(HORIZON)) + FUTURE + f""",
base AS (SELECT facility_id, department, scenario_id, step, p.ts, capacity, rmse, w,
    c + {' + '.join(f'w[{at_(c)}] * f.{c}' for c in KNOWN)} AS base, CASE WHEN active THEN docc ELSE 0.0 END AS shift
  FROM (SELECT facility_id, scenario_id, step, ts, active, docc, {calendar().replace("round(", "(").replace(", 6) + 0.0", ")")}, {commas(C.EXOGENOUS + C.EXOGENOUS_ROLLING_FEATURES)}
        FROM projected JOIN rolled USING (facility_id, scenario_id, ts)) f
  JOIN (SELECT facility_id, scenario_id, ts FROM projected) p USING (facility_id, scenario_id, ts) JOIN ridge USING (facility_id)),
tail AS (SELECT facility_id, department, list(occupied ORDER BY ts) AS h FROM (
    SELECT facility_id, department, ts, occupied FROM long QUALIFY row_number() OVER (PARTITION BY facility_id, department ORDER BY ts DESC) <= 72) GROUP BY ALL),
roll AS (
  SELECT r.facility_id, r.department, s.scenario_id, 0 AS step, CAST(NULL AS TIMESTAMP) AS ts, list_concat(list_transform(range(72 - len(h)), lambda i: my), list_transform(h, lambda x: coalesce(x, my))) AS past
  FROM ridge r JOIN tail USING (facility_id, department) JOIN (SELECT DISTINCT facility_id, scenario_id FROM scenario) s USING (facility_id)
  UNION ALL
  SELECT b.facility_id, b.department, b.scenario_id, b.step, CAST(b.ts AS TIMESTAMP), list_append(past[2:], greatest(0.0, least(CAST(capacity AS DOUBLE), base + shift
    + {' + '.join(f'w[{at_(f"lag_{k}")}] * past[{73 - k}]' for k in C.TARGET_LAGS)}
    + {' + '.join(f'w[{at_(f"rolling_mean_{k}")}] * list_sum(past[{73 - k}:72]) / {k}.0e0' for k in C.TARGET_WINDOWS)})))
  FROM roll JOIN base b ON b.facility_id = roll.facility_id AND b.department = roll.department AND b.scenario_id = roll.scenario_id AND b.step = roll.step + 1),
value AS (SELECT facility_id, scenario_id, department, step, ts, capacity, rmse, past[72] AS v FROM roll JOIN ridge USING (facility_id, department) WHERE step > 0),
points AS (SELECT facility_id, scenario_id, department, step, {iso('ts')} AS timestamp, capacity, {r('v', 1)} AS occupied,
  {r(f'greatest(0.0, v - {real(C.BAND_Z)} * rmse)', 1)} AS lower, {r(f'least(CAST(capacity AS DOUBLE), v + {real(C.BAND_Z)} * rmse)', 1)} AS upper,
  {r('v / capacity', 3)} AS utilization FROM value)"""
add("ridge_forecast", RIDGE_POINTS + " SELECT * FROM points")
add("ridge_what_if", RIDGE_POINTS + PEAK + SUMMARY)

# --- thresholds and alerts ---------------------------------------------------------------------------------------------------------
UPDATES = f""",
upd AS (SELECT CAST(user_id % 4 AS VARCHAR) AS facility_id,
  CASE event_type WHEN 'error' THEN 'icu' WHEN 'click' THEN 'emergency' WHEN 'view' THEN 'pediatric' WHEN 'purchase' THEN 'ward'
    WHEN 'signup' THEN 'maternity' END AS department,
  {real(0.45)} + (event_id % 60) / 100.0e0 AS utilization_threshold, CAST(user_id AS VARCHAR) AS updated_by, ts AS updated_at,
  event_id // 3 AS request_id FROM events),
bad AS (SELECT u.*, CASE WHEN c.capacity IS NULL THEN 'Unknown department: ' || department
    ELSE 'Thresholds must be between 0.5 and 1.0.' END AS violation
  FROM upd u LEFT JOIN cap c USING (facility_id, department)
  WHERE c.capacity IS NULL OR utilization_threshold < 0.5 OR utilization_threshold > 1.0),
stored AS (SELECT facility_id, department, utilization_threshold, updated_by, updated_at FROM (
    SELECT facility_id, department, {real(0.9)} AS utilization_threshold, 'admin' AS updated_by, TIMESTAMP '2024-01-01 00:00:00' AS updated_at, 0 AS src FROM cap
    UNION ALL
    SELECT facility_id, department, utilization_threshold, updated_by, updated_at, 1 FROM upd
    WHERE request_id NOT IN (SELECT request_id FROM bad))
  QUALIFY row_number() OVER (PARTITION BY facility_id, department
    ORDER BY updated_at DESC, src DESC, utilization_threshold DESC, updated_by DESC) = 1)"""


def percent(x: str) -> str:
    return f"CAST(CAST({r(f'{x} * 100.0e0', 0)} AS INTEGER) AS VARCHAR) || '%'"


def breaches(threshold: str, source: str = "points", target: str = "alerts") -> str:
    """``threshold``: a literal, or ``stored`` for the threshold table."""
    limit = "coalesce(t.utilization_threshold, " + real(0.9) + ")" if threshold == "stored" else threshold
    join = "LEFT JOIN stored t USING (facility_id, department)" if threshold == "stored" else ""
    return f""",
{target} AS (SELECT facility_id, scenario_id, department, {LABEL} AS label, timestamp, utilization, {r('thr', 3)} AS threshold,
  CASE WHEN utilization >= least(1.0, thr + {real(C.CRITICAL_MARGIN)}) THEN 'critical' ELSE 'warning' END AS severity,
  {LABEL} || ' occupancy is forecast to reach ' || {percent('utilization')} || ' against a ' || {percent('thr')} || ' threshold.' AS message
  FROM (SELECT p.*, {limit} AS thr FROM {source} p {join}) WHERE utilization >= thr
  QUALIFY row_number() OVER (PARTITION BY facility_id, scenario_id, department ORDER BY step) = 1)"""


RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY facility_id, scenario_id ORDER BY utilization DESC, {ORDER}) AS position FROM alerts"""
add("alerts", CUT_POINTS + UPDATES + breaches("stored") + RANKED)
add("alerts_override", CUT_POINTS + breaches(real(OVERRIDE)) + RANKED)
add("what_if_alerts", ALL_POINTS + UPDATES + breaches("stored") + RANKED)
add("thresholds_from_snapshot", BASE + UPDATES + f""",
batch AS (SELECT *, request_id % 3 AS b FROM upd WHERE request_id NOT IN (SELECT request_id FROM bad)
  QUALIFY row_number() OVER (PARTITION BY facility_id, department, b ORDER BY updated_at DESC, utilization_threshold DESC, updated_by DESC) = 1),
written AS (SELECT facility_id, department, utilization_threshold, updated_by, updated_at, b FROM batch
  UNION ALL SELECT facility_id, department, {real(0.9)}, 'admin', TIMESTAMP '2024-01-01 00:00:00', -1 FROM cap)
SELECT facility_id, department, utilization_threshold, updated_by, {iso('updated_at')} AS updated_at, (SELECT 2 * count(*) FROM batch WHERE b = 2) AS tail_rows
FROM written QUALIFY row_number() OVER (PARTITION BY facility_id, department ORDER BY b DESC) = 1""")
add("thresholds", BASE + UPDATES + f" SELECT facility_id, department, utilization_threshold, updated_by, {iso('updated_at')} AS updated_at FROM stored")
add("threshold_violations", BASE + UPDATES + f"""
SELECT facility_id, department, round(utilization_threshold, 6) AS utilization_threshold, updated_by, {iso('updated_at')} AS updated_at,
  request_id, violation FROM bad""")

# The three runs: stored thresholds, one threshold for all, stored thresholds again.
MERGED = CUT_POINTS + UPDATES + breaches("stored", target="first_run") + breaches(real(OVERRIDE), target="second_run") + f""",
runs AS (SELECT *, 1 AS run, '{NOW[1]}' AS seen_at FROM first_run UNION ALL SELECT *, 2, '{NOW[2]}' FROM second_run
         UNION ALL SELECT *, 3, '{NOW[3]}' FROM first_run),
keyed AS (SELECT facility_id, department, timestamp AS forecast_timestamp, threshold, min(run) AS first_seen,
  arg_min(label, run) AS label, arg_max(utilization, run) AS utilization, arg_max(severity, run) AS severity,
  arg_max(message, run) AS message, max(seen_at) AS created_at, arg_min(utilization, run) AS first_utilization FROM runs GROUP BY ALL),
history AS (SELECT row_number() OVER (PARTITION BY facility_id ORDER BY first_seen, first_utilization DESC, department, forecast_timestamp, threshold) AS id,
  facility_id, department, label, forecast_timestamp, utilization, threshold, severity, message, created_at FROM keyed)"""
add("alert_merge", MERGED + " SELECT * FROM history")
add("alert_history", MERGED + """ SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY forecast_timestamp DESC, id DESC) AS position FROM history) WHERE position <= 2""")
add("alert_stream_merge", CUT_POINTS + breaches(real(OVERRIDE)) + f"""
SELECT row_number() OVER (PARTITION BY facility_id ORDER BY least(1.0e0, utilization + 0.01e0) DESC, department, timestamp, threshold) AS id,
  facility_id, department, label, timestamp AS forecast_timestamp, least(1.0e0, utilization + 0.03e0) AS utilization, threshold, severity, message,
  '{NOW[3]}' AS created_at FROM alerts WHERE scenario_id = 0""")

# --- scenarios, settings, metadata -----------------------------------------------------------------------------------------------------
PAYLOAD = f"""'observed load ' || n AS description, {real(0.2)} + (n * 13 % 520) / 100.0e0 AS admissions_multiplier,
  1.0e0 + (n % 7) / 10.0e0 AS discharges_multiplier, {real(0.5)} + (n % 40) / 10.0e0 AS emergency_multiplier,
  (n % 21 - 10) / 10.0e0 AS outbreak_delta, CAST(n * 17 % 220 - 100 AS DOUBLE) AS occupancy_delta, 2 + n * 11 % 175 AS duration_hours"""
PAYLOADS = f"""
ins_p AS (SELECT facility_id, CAST(NULL AS BIGINT) AS id, 'surge ' || day AS name, day, n, {PAYLOAD} FROM (
  SELECT CAST(user_id % 4 AS VARCHAR) AS facility_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)),
upd_p AS (SELECT facility_id, {case('event_type', [(k, str(3 * int(v))) for k, v in KEY_OF_EVENT])} AS id, 'revised ' || event_type AS name, {PAYLOAD} FROM (
  SELECT CAST(user_id % 4 AS VARCHAR) AS facility_id, event_type, count(*) AS n FROM events GROUP BY ALL))"""
BOUNDS = C.SCENARIO_BOUNDS
VALID = " AND ".join([
    "length(name) BETWEEN 3 AND 80", "length(description) <= 240",
    *[f"{c} BETWEEN {low} AND {high}" for c, (low, high) in BOUNDS.items()],
])
broken = " UNION ALL ".join(
    f"SELECT *, '{c}' AS violation FROM ins_p WHERE NOT ({c} BETWEEN {low} AND {high})" for c, (low, high) in BOUNDS.items()
)
add("scenario_violations", "WITH " + PAYLOADS + f""", broken AS ({broken})
SELECT facility_id, id, name, description, {commas(f"round({c}, 6) AS {c}" for c in list(BOUNDS)[:5])}, duration_hours, violation FROM broken""")
INPUTS = ["name", "description", *BOUNDS]
TABLE = PAYLOADS + f""",
made AS (SELECT row_number() OVER (PARTITION BY facility_id ORDER BY name) AS id, * EXCLUDE (id) FROM ins_p WHERE {VALID}),
kept AS (SELECT m.id, m.facility_id, {commas(f"CASE WHEN u.id IS NULL THEN m.{c} ELSE u.{c} END AS {c}" for c in INPUTS)},
    'admin' AS created_by, '{NOW[1]}' AS created_at, CASE WHEN u.id IS NULL THEN '{NOW[1]}' ELSE '{NOW[2]}' END AS updated_at
  FROM made m LEFT JOIN (SELECT * FROM upd_p WHERE {VALID}) u USING (facility_id, id)),
quiet AS (SELECT facility_id, 'surge ' || day AS name FROM ins_p QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY n, day) = 1),
book AS (SELECT * FROM kept WHERE (facility_id, name) NOT IN (SELECT (facility_id, name) FROM quiet))"""
add("scenario_table", "WITH " + TABLE + f"""
SELECT id, facility_id, name, description, {commas(f"round({c}, 6) AS {c}" for c in list(BOUNDS)[:5])}, duration_hours,
  created_by, created_at, updated_at FROM book""")
BOOKED = """,
booked AS (SELECT facility_id, id AS scenario_id, name, admissions_multiplier AS fa, discharges_multiplier AS fd, emergency_multiplier AS fe,
  outbreak_delta AS dout, occupancy_delta AS docc, duration_hours AS duration FROM book)"""
add("scenario_runs", BASE + "," + TABLE + SCENARIOS + BOOKED + ERRORS + points("greatest(6, least(168, duration))", "booked") + PEAK + f""",
entries AS (SELECT facility_id, scenario_id, string_agg('{{"department":"' || department || '","label":"' || {LABEL} ||
  '","peak_occupancy":' || CAST(occupied AS VARCHAR) || ',"peak_timestamp":"' || timestamp || '","capacity":' || capacity || '}}',
  ',' ORDER BY department) AS body FROM peak GROUP BY ALL)
SELECT b.facility_id, b.id, b.name, '{NOW[3]}' AS last_run_at, '{NOW[3]}' AS updated_at,
  '{{"generated_at":"{NOW[3].replace("T", " ")}","summary":[' || body || ']}}' AS last_run_summary
FROM book b JOIN entries e ON b.facility_id = e.facility_id AND b.id = e.scenario_id""")
add("settings", f"""WITH log AS (
  SELECT 'status.' || o_orderstatus AS key, '{{"order":' || o_orderkey || '}}' AS value, o_orderdate AS updated_at, 0 AS src FROM orders
  UNION ALL SELECT 'last.' || (user_id % 4) || '.' || event_type, props, ts, 1 FROM events)
SELECT key, value, {iso('updated_at')} AS updated_at FROM log
QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, src DESC, value DESC) = 1""")
add("metadata_history", BASE + META + f"""
SELECT facility_id, 'whole' AS source_name, 'event_level_his' AS source_type, rows, coverage_start, coverage_end,
  {commas(f"{d} AS capacity_{d}" for d in D)}, '{NOW[2]}' AS recorded_at FROM meta JOIN caps USING (facility_id)""")

# --- the engine, end to end -----------------------------------------------------------------------------------------------------------
add("engine_status", BASE + META + f"""
SELECT facility_id, 'Events export' AS source_name, 'event_level_his' AS source_type, rows, coverage_start, coverage_end,
  {commas(f"{d} AS capacity_{d}" for d in D)}, CAST(NULL AS VARCHAR) AS trained_at, CAST(0 AS BIGINT) AS rejected_rows FROM meta JOIN caps USING (facility_id)""")
NOW_ROWS = overview_departments("fact")
add("engine_dashboard", FACT + SCENARIOS + PLAIN + ERRORS + points(str(HORIZON), "plain") + PEAK + f""",
shown AS (WITH {(FACT + NOW_ROWS)[5:]}),
figures AS ({ORACLE["overview_analytics"]})
SELECT p.facility_id, p.department, {LABEL.replace("department", "p.department", 1)} AS label, p.capacity, n AS horizon_hours, p.occupied AS peak_occupancy, p.timestamp AS peak_timestamp,
  s.occupied, s.available, s.utilization, s.delta_24h, {real(0.9)} AS utilization_threshold, peak_admission_hour, busiest_day
FROM peak p JOIN shown s ON s.facility_id = p.facility_id AND s.department = p.department JOIN figures f ON f.facility_id = p.facility_id""")
FIXED_CUT = ",\ntotal AS (SELECT * FROM whole WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')"
FIXED_BASE = CUT_BASE.replace(CUT_TOTAL, FIXED_CUT)
add("engine_alerts", FIXED_BASE + SCENARIOS + PLAIN + ERRORS + points(str(HORIZON), "plain") + breaches(real(OVERRIDE)) + """,
history AS (SELECT row_number() OVER (PARTITION BY facility_id ORDER BY utilization DESC, department, timestamp, threshold) AS id, facility_id, department, label,
  timestamp AS forecast_timestamp, utilization, threshold, severity, message FROM alerts)
SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY forecast_timestamp DESC, id DESC) AS position FROM history""")
MADE = """,
booked AS (SELECT facility_id, id AS scenario_id, name, admissions_multiplier AS fa, discharges_multiplier AS fd, emergency_multiplier AS fe,
  outbreak_delta AS dout, occupancy_delta AS docc, duration_hours AS duration FROM made)"""
MADE_POINTS = BASE + "," + TABLE + SCENARIOS + MADE + ERRORS + points("greatest(6, least(168, duration))", "booked") + PEAK
add("engine_simulation", MADE_POINTS + f"""
SELECT p.facility_id, p.scenario_id, department, {LABEL} AS label, occupied AS peak_occupancy, timestamp AS peak_timestamp, capacity, m.name, 1 AS is_stored
FROM peak p JOIN made m ON m.facility_id = p.facility_id AND m.id = p.scenario_id""")
add("engine_scenarios", MADE_POINTS + f"""
SELECT p.facility_id, m.id, m.name, department, {LABEL} AS label, occupied AS peak_occupancy, timestamp AS peak_timestamp, CAST(capacity AS BIGINT) AS capacity
FROM peak p JOIN made m ON m.facility_id = p.facility_id AND m.id = p.scenario_id""")

# --- streaming: hours closed by the slower of the two watermarks --------------------------------------------------------------------------------
CLOSED = SPINE.replace("max(db) AS hi", "(SELECT max(ab) FROM clean) - INTERVAL 3 HOUR AS hi")
add("stream_hourly_occupancy", "WITH " + EVENT_ENCOUNTERS + "," + cleaning() + "," + CLOSED + f"""
SELECT facility_id, {iso('ts')} AS ts, admissions, discharges, emergency_cases, {commas(OCC)} FROM total""")
add("stream_hourly_flow", BASE + f""",
mark AS (SELECT least(max(ab), max(db)) - INTERVAL 2 HOUR AS w FROM clean)
SELECT facility_id, {iso('ts')} AS ts, admissions, discharges, emergency_cases FROM total, mark
WHERE admissions + discharges > 0 AND ts + INTERVAL 1 HOUR <= w""")
