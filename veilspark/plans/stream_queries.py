"""Queries on event time: windows, sessions, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events as EV
from .catalog import Tables, query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t: Tables) -> DataFrame:
    return EV.tumbling(t("events"), "1 hour", ["event_type"])


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) o(k) GROUP BY 1, 2")
def events_sliding(t: Tables) -> DataFrame:
    return EV.sliding(t("events"), "1 hour", "30 minutes", ["event_type"])


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def events_session(t: Tables) -> DataFrame:
    return EV.sessions(t("events"), "30 minutes", ["user_id"])


@query("SELECT a.event_id, b.v AS asof_v FROM (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def events_asof(t: Tables) -> DataFrame:
    left = t("events").where("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = t("events").where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return EV.as_of(left, right, "user_id", "ts", "v").select("event_id", "asof_v")
