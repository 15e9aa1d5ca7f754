"""Heater-control audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import TELEMETRY, query, rounded, telemetry
from tidemark.operators import control as ctl
from tidemark.session import cut_lineage

ORDER = ["timestamp", "event_id"]
WIN = "(PARTITION BY tank ORDER BY timestamp, event_id)"
BEFORE = "(PARTITION BY tank ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
E_SQL = f"(SELECT *, 50.0 - temperature AS e FROM {TELEMETRY})"


def _set(spark, sf):
    return telemetry(spark, sf).withColumn("temp_set", F.lit(50.0))


@query(
    "e19_pid_replay",
    f"""SELECT event_id, round(0.5 * e + 0.01 * coalesce(sum(e) OVER {BEFORE}, 0) + 0.00625 * CASE
      WHEN row_number() OVER {WIN} = 1 THEN 0 WHEN row_number() OVER {WIN} = 2 THEN lag(e) OVER {WIN} - 15
      ELSE lag(e) OVER {WIN} - lag(temperature, 2) OVER {WIN} END, 7) + 0.0 AS pid FROM {E_SQL}""",
)
def _e19(spark, sf):
    out = ctl.pid_replay(_set(spark, sf), "tank", ORDER, "temp_set", "temperature", 0.5, 0.01, 0.00625)
    return rounded(out.select("event_id", "pid"), 7, "pid")


@query(
    "e19_pid_textbook",
    f"""SELECT event_id, round(0.5 * e + 0.25 * coalesce(e - lag(e) OVER {WIN}, 0), 5) + 0.0 AS pid FROM {E_SQL}""",
)
def _e19b(spark, sf):
    out = ctl.pid_replay(
        _set(spark, sf), "tank", ORDER, "temp_set", "temperature", 0.5, 0, 0.25, mode="textbook"
    )
    return rounded(out.select("event_id", "pid"), 5, "pid")


STATES = f"""r AS (SELECT *, temperature < 30 AS a, temperature > 45 AS b, row_number() OVER {WIN} AS i FROM {TELEMETRY}),
  s AS (SELECT event_id, tank, i, CASE WHEN a OR b THEN 1 ELSE 0 END AS on_ FROM r WHERE i = 1 UNION ALL
    SELECT r.event_id, r.tank, r.i, CASE WHEN r.a OR (s.on_ = 0 AND r.b) THEN 1 ELSE 0 END FROM s
    JOIN r ON r.tank = s.tank AND r.i = s.i + 1)"""


def _states(spark, sf):
    t = telemetry(spark, sf)
    return ctl.hysteresis_replay(t, "tank", ORDER, F.col("temperature") < 30, F.col("temperature") > 45)


@query("e20_hysteresis_replay", f'WITH RECURSIVE {STATES} SELECT event_id, on_ AS "on" FROM s')
def _e20(spark, sf):
    return _states(spark, sf).select("event_id", "on")


@query(
    "e20_pump_state",
    f"""SELECT event_id, CASE WHEN 0.5 * e < -5 AND temperature > 50 THEN 'off' WHEN 0.5 * e > 5 AND temperature < 50 THEN 'on'
      ELSE 'stable' END AS state FROM {E_SQL}""",
)
def _e20b(spark, sf):
    t = _set(spark, sf)
    pid = 0.5 * (F.col("temp_set") - F.col("temperature"))
    return t.select("event_id", ctl.pump_state(pid, F.col("temperature"), F.col("temp_set"), -5, 5).alias("state"))


@query(
    "e21_duty_cycle",
    f"""WITH RECURSIVE {STATES}, c AS (SELECT *, CASE WHEN on_ <> lag(on_) OVER (PARTITION BY tank ORDER BY i) THEN 1 ELSE 0
        END AS ch FROM s),
      g AS (SELECT *, sum(ch) OVER (PARTITION BY tank ORDER BY i) AS run FROM c),
      u AS (SELECT tank, run, on_, count(*) AS n FROM g GROUP BY ALL)
    SELECT tank, CAST(sum(n) AS BIGINT) AS ticks, round(coalesce(sum(n) FILTER (on_ = 1), 0) / sum(n), 6) AS share_on,
      count(*) - 1 AS switches, round(avg(n) FILTER (on_ = 1), 6) AS mean_run_on, max(n) FILTER (on_ = 1) AS longest_run_on
      FROM u GROUP BY tank""",
)
def _e21(spark, sf):
    return rounded(ctl.duty_cycle(cut_lineage(_states(spark, sf)), "tank", ORDER, "on"), 6, "share_on", "mean_run_on")


@query(
    "e22_sessionise",
    f"""WITH a AS (SELECT *, CASE WHEN epoch_us(timestamp - lag(timestamp) OVER {WIN}) > 7200e6 THEN 1 ELSE 0 END AS nw
      FROM {TELEMETRY}) SELECT event_id, CAST(1 + sum(nw) OVER {WIN} AS BIGINT) AS session FROM a""",
)
def _e22(spark, sf):
    out = ctl.sessionise(telemetry(spark, sf), "tank", ORDER, "timestamp", 7200)
    return out.select("event_id", "session")
