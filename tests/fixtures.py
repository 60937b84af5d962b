"""Small inputs. Expected numbers are worked out from them by ``counted``, hour by hour, and not stored."""

import csv
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bedtide.sources.readers import canonical_encounters, canonical_readings

START = datetime(2025, 5, 1)
COLUMNS = ["admission_time", "discharge_time", "department", "admission_type"]
UNITS = {"Intensive Unit 2": "icu", "Surgery B": "ward", "Trauma bay": "emergency", "Children's clinic": "pediatric", "Internal medicine": "ward"}
ORDER = ["icu", "ward", "emergency", "pediatric"]


def visit_rows(n=230, seed=19):
    """Visits at random minutes, 20 minutes to 3.5 hours apart, for 30 minutes to 3 days; the first one at START."""
    dice, now = random.Random(seed), START
    for _ in range(n):
        unit = dice.choice(list(UNITS))
        kind = dice.choice(["Routine", "Routine", "Urgent", "Walk in"])
        yield now, now + timedelta(minutes=dice.randint(30, 4320)), unit, kind
        now += timedelta(minutes=dice.randint(20, 210))


def counted(rows):
    """(hour, admissions, discharges, emergencies, occupied by department) for every hour, by plain counting."""
    rows = [(a.replace(minute=0, second=0), b, UNITS[u], k) for a, b, u, k in rows]
    last = lambda b: b if b == b.replace(minute=0, second=0) else b.replace(minute=0, second=0) + timedelta(hours=1)
    rows = [(a, max(last(b), a + timedelta(hours=1)), d, k) for a, b, d, k in rows]
    hour, end = min(r[0] for r in rows), max(r[1] for r in rows)
    while hour <= end:
        inside = Counter(d for a, b, d, _ in rows if a <= hour < b)
        yield (hour, sum(a == hour for a, *_ in rows), sum(b == hour for _, b, *_ in rows),
               sum(a == hour and (d == "emergency" or k == "Urgent") for a, _, d, k in rows), [inside[d] for d in ORDER])
        hour += timedelta(hours=1)


HOURS = sum(1 for _ in counted(visit_rows()))


def visits(spark, facility=None, n=230):
    rows = spark.createDataFrame([(a.isoformat(), b.isoformat(), u, k) for a, b, u, k in visit_rows(n)], COLUMNS)
    return canonical_encounters(rows if facility is None else rows.withColumn("facility_id", F.lit(facility)))


def visits_csv(path, n=230):
    with open(path, "w", newline="") as out:
        lines = csv.writer(out)
        lines.writerow(["visit_id", *COLUMNS])
        lines.writerows([i, a.isoformat(), b.isoformat(), u, k] for i, (a, b, u, k) in enumerate(visit_rows(n)))
    return str(path)


def readings(spark, rows, columns=None):
    columns = columns or ["timestamp", "admissions", "discharges", "icu_occupied", "ward_occupied", "emergency_occupied", "pediatric_occupied"]
    return canonical_readings(spark.createDataFrame(rows, columns))
