"""Alerts as a stream against alerts in batch, with late rows, and the timer."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillmere import streaming
from quillmere.operators import observability
from quillmere.streaming.alerts import step

SCHEMA = "service string, ts timestamp, latency_s double, n_errors long, fallback boolean, cost_usd double"
ZERO = datetime(2024, 1, 1, 8)
NAMES = ("high_p95", "high_errors", "high_fallback", "cost_spike")


def trace(service, minute, bad, k=0):
    return (service, ZERO + timedelta(minutes=minute, seconds=7 * k % 60), 9.0 if bad else 0.4, 300 if bad else 0, bad, 0.5 if bad else 0.01)


def bad(minute):
    return 10 <= minute < 25 or minute in (30, 31, 33) or 60 <= minute < 71 or minute == 179


def test_stream_equals_batch(spark, tmp_path):
    """Windows of a minute; a third of the rows come up to eight minutes late, in later files. Service b ends at minute 90, a has a gap."""
    rows = [(m + (8 if k == 2 else 0), trace("a", m, bad(m), k)) for m in range(200) if not 120 <= m < 140 for k in range(3)]
    rows = sorted(rows + [(m, trace("b", m, bad(m + 2))) for m in range(90)], key=lambda x: x[0])
    rows += [(m, trace("a", m, False)) for m in (400, 500)]  # a window before the last one is closed by it
    folder = {x: str(tmp_path / x) for x in ("in", "stats", "out", "seen", "state")}
    cuts = [0, 70, 75, 250, 420, len(rows) - 1, len(rows)]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame([r for _, r in rows[i:j]], SCHEMA).coalesce(1).write.mode("append").parquet(folder["in"])
        if k in (1, 2, 3, 5):  # both streams go on from where they were
            traces = streaming.trace_stream(spark, folder["in"], SCHEMA, 1)
            stats = streaming.windowed_stats(traces, "1 minute", None, "10 minutes", of=("service",))
            streaming.run_available(stats, folder["stats"], folder["seen"])
            read = spark.readStream.schema(stats.schema).parquet(folder["stats"])
            states = streaming.alert_states(read, pending=5, silence=15, of=("service",))
            streaming.run_available(states, folder["out"], folder["state"])
    got = spark.read.parquet(folder["out"])
    whole = spark.createDataFrame([r for m, r in rows if m < 500], SCHEMA)
    stats = observability.window_stats(whole, "1 minute", None, ("service",))
    flags = observability.alerts(stats, pending=5, of=("service",)).collect()
    assert got.where("state <> 'expired'").count() == 4 * stats.count()  # nothing was dropped, nothing came twice
    want = {(r.service, n, r.start) for r in flags for n in NAMES if r[n]}
    # A silence ends an alert's past in both: batch looks back five minutes, less than the silence.
    assert {(r.service, r.alert, r.start) for r in got.where("state = 'firing'").collect()} == want and len(want) > 30
    holds = stats.select("service", "start", *(c.alias(n) for n, c in observability.conditions().items())).collect()
    assert {(r.service, r.alert, r.start) for r in got.where("state in ('firing', 'pending')").collect()} == {(r.service, n, r.start) for r in holds for n in NAMES if r[n]}
    expired = {(r.service, r.alert, r.start) for r in got.where("state = 'expired'").collect()}
    ends = {("b", 89), ("a", 119), ("a", 199)}
    assert expired == {(s, n, ZERO + timedelta(minutes=m + 15)) for s, m in ends for n in NAMES}


def test_step():
    s, h, now = step([], [], 0, True, 120)
    assert now == "firing"
    s, h, now = step(s, h, 60, False, 120)
    assert (s, h, now) == ([0, 60], [True, False], "inactive")
    s, h, now = step(s, h, 120, True, 120)
    assert now == "pending"
    s, h, now = step(s, h, 181, True, 120)
    assert (s, now) == ([120, 181], "firing")


def test_batch_alerts_by_spans(spark):
    """Windows dealt by spans give what one ordered window gives."""
    rows = [(ZERO + timedelta(minutes=17 * k % 4000), 7.0 if k % 7 else 1.0, 0.1 if k % 3 else 0.0, 0.5 if k % 5 else None, 0.4 * (k % 4)) for k in range(300)]
    stats = spark.createDataFrame(rows, "start timestamp, p95 double, error_ratio double, fallback_ratio double, cost double")
    for pending in (5, 40, 180):
        got = {r.start: tuple(r)[1:] for r in observability.alerts(stats, pending=pending).collect()}
        table = sorted(rows, key=lambda r: r[0])
        for at, *_ in table:
            held = [r for r in table if at - timedelta(minutes=pending) <= r[0] <= at]
            own = next(r for r in table if r[0] == at)
            assert got[at] == (all(r[1] > 6 for r in held), all(r[2] > 0.05 for r in held), all((r[3] or 0) > 0.2 for r in held), own[4] > 1)
    assert observability.alerts(stats.where(F.lit(False))).count() == 0
