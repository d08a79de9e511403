"""Sketches by day against exact counts, within their stated bounds, with
nulls, repeated rows, days written again and no events."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from folium.operators import rollups
from folium.operators.storage import shared_path

SCHEMA = "ts timestamp_ntz, event_type string, user_id bigint, value double, day int, n string"


def some_events(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=rng.randrange(24 * 40)), rng.choice(("view", "click", None)), rng.choice((1, 1, 2, 3, rng.randrange(3000), None)), rng.choice((None, rng.random() * 100))) for _ in range(6000)]
    rows += rows[:50] + [(None, "view", 5, 1.0)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), rows


def exact(rows, of):
    groups = {}
    for ts, kind, who, value in rows:
        if ts is not None:
            groups.setdefault((of(ts), kind), []).append((who, value))
    return groups


def within(row, own):
    users = Counter(w for w, _ in own if w is not None)
    values = sorted(v for _, v in own if v is not None)
    assert row.n == len(own) and abs(row.users - len(users)) <= max(1, 4 * 1.04 / 64 * len(users))
    below = sum(v <= row.median for v in values) / len(values)
    assert abs(below - 0.5) <= 2 * rollups.RANK_ERROR + 1 / len(values)
    for item in row.often[:3]:
        assert abs(item["count"] - users[item["item"]]) <= len(own) / (0.75 * rollups.TRACKED) * 3.5


def test_rollups(spark):
    frame, rows = some_events(spark)
    path = shared_path(spark, "days")
    rollups.write_days(frame, path)
    rollups.write_days(frame.where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'"), path)  # days again
    for period, of in ((F.date_trunc("month", "day"), lambda t: t.month), (F.lit(0), lambda t: 0)):
        groups = exact(rows, of)
        got = rollups.rolled_up(spark, path, period).collect()
        assert len(got) == len(groups)
        for r in got:
            within(r, groups[(r.period.month if r.period else 0), r.kind])
    own = exact([r for r in rows if r[0] and 5 <= r[0].day <= 9 and r[0].month == 1], lambda t: 0)
    for r in rollups.rolled_up(spark, path, F.lit(0), first="2024-01-05", last="2024-01-09").collect():
        within(r, own[0, r.kind])


def test_frequencies(spark):
    frame, rows = some_events(spark)
    path = shared_path(spark, "days")
    rollups.write_days(frame, path)
    asked = spark.createDataFrame([(k,) for k in [*range(3000), 1, None, 99_999]], "who bigint")
    got = {(r.who, r.kind): r.n for r in rollups.frequencies(spark, path, asked).collect()}
    want = Counter((w, k) for ts, k, w, _ in rows if ts is not None and w is not None)
    totals = Counter(k for ts, k, w, _ in rows if ts is not None and w is not None)
    assert all(got[key] >= n for key, n in want.items())
    over = sum(n > want[key] + rollups.count_error(totals[key[1]]) for key, n in got.items())
    assert over <= 0.01 * len(got)


def test_no_events(spark):
    frame, _ = some_events(spark)
    path = shared_path(spark, "days")
    rollups.write_days(frame, path)
    before = rollups.rolled_up(spark, path, F.lit(0)).count()
    rollups.write_days(frame.limit(0), path)
    assert rollups.rolled_up(spark, path, F.lit(0)).count() == before == 3
    assert rollups.rolled_up(spark, path, F.lit(0), first="2030-01-01").count() == 0
