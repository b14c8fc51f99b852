"""Queries of jobs under a watchdog, as a scan and as a stream. Register beside the catalogue's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.plans.catalogue import base, query
from quirefold.sources.shared import shared_folder
from quirefold.streaming import progress, watchdog

#: Events as what clients report: jobs that begin, go on and end, some out of date, and clients that hide and come back.
WATCHED = """SELECT user_id AS client, event_id * 600 + 600 AS ts_ms, event_id AS seq,
    CASE WHEN event_id % 11 = 0 THEN 'hidden' WHEN event_id % 11 = 1 THEN 'visible' WHEN event_id % 13 = 0 THEN 'result' WHEN event_id % 7 = 0 THEN 'start' ELSE 'progress' END AS kind,
    CAST(floor(event_id / 1000) AS BIGINT) - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS job,
    CASE event_type WHEN 'click' THEN 'inspect' WHEN 'view' THEN 'photos' WHEN 'error' THEN 'verify' WHEN 'signup' THEN 'split' ELSE 'other' END AS stage, CASE WHEN value < 90 THEN CAST(event_id % 101 AS DOUBLE) / 100 END AS within
    FROM {events} WHERE user_id IS NOT NULL AND event_id IS NOT NULL"""
#: How far behind the latest an event of the stream may be; what is later than that before the end has not been decided.
DELAY_MS = 10_000


def band(side: int) -> str:
    return "CASE stage " + " ".join(f"WHEN '{s}' THEN {b[side]}::DOUBLE" for s, b in progress.BANDS.items()) + f" ELSE {side}.0::DOUBLE END"


#: The state machine as a recursion over each client's events. Every level has names for what the next one needs.
MACHINE = f"""WITH RECURSIVE v AS ({WATCHED}), u AS (SELECT max(ts_ms) - {DELAY_MS} AS until FROM v),
    e AS (SELECT client, ts_ms, kind, job, stage, within, row_number() OVER (PARTITION BY client ORDER BY ts_ms, seq) AS k FROM v, u WHERE ts_ms <= until
        UNION ALL SELECT client, any_value(until) + 1, 'end', NULL, NULL, NULL, count(*) + 1 FROM v, u WHERE ts_ms <= until GROUP BY client),
    w AS (SELECT DISTINCT client, 0::BIGINT AS k, -1::BIGINT AS job, 0::DOUBLE AS value, 0::DOUBLE AS low, 1::DOUBLE AS high, NULL::BIGINT AS sent, NULL::VARCHAR AS stage, true AS visible, true AS over, NULL::BIGINT AS deadline,
            NULL::BIGINT AS ended, NULL::BIGINT AS ended_job, NULL::BIGINT AS ended_at, NULL::BIGINT AS told, NULL::VARCHAR AS what FROM e
        UNION ALL SELECT client, k1, CASE WHEN fresh THEN ejob ELSE job END, value2, low2, high2, CASE WHEN sends THEN ts_ms WHEN fresh THEN NULL ELSE sent END, CASE WHEN moves THEN estage WHEN fresh THEN NULL ELSE stage END, visible2,
            CASE WHEN live AND kind = 'result' THEN true WHEN fresh THEN false ELSE over1 END,
            CASE WHEN kind = 'hidden' THEN NULL WHEN kind = 'visible' THEN CASE WHEN NOT over1 THEN ts_ms + {progress.STALL_MS} END WHEN live AND kind = 'result' THEN NULL WHEN moves THEN CASE WHEN visible THEN ts_ms + {progress.STALL_MS} END ELSE left_ END,
            ended0, CASE WHEN ended0 IS NOT NULL THEN job END, CASE WHEN ended0 IS NOT NULL THEN CAST(floor(value * 1000 + 0.5) AS BIGINT) END,
            CASE WHEN live AND kind = 'result' THEN 1000 WHEN sends THEN CAST(floor(value2 * 1000 + 0.5) AS BIGINT) END, CASE WHEN live AND kind = 'result' THEN 'result' WHEN sends THEN 'progress' END
        FROM (SELECT *, moves AND (changed OR ts_ms - sent >= {progress.LEAST_MS}) AS sends,
                CASE WHEN live AND kind = 'result' THEN 1.0::DOUBLE WHEN moves THEN greatest(value1, low2 + (high2 - low2) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(within, 0)))) ELSE value1 END AS value2
            FROM (SELECT *, CASE WHEN moves AND changed THEN greatest(elow, value1) WHEN fresh THEN 0 ELSE low END AS low2, CASE WHEN moves AND changed THEN greatest(ehigh, value1) WHEN fresh THEN 1 ELSE high END AS high2
                FROM (SELECT *, live AND kind <> 'result' AS moves, fresh OR sent IS NULL OR estage IS DISTINCT FROM stage AS changed, CASE WHEN fresh THEN 0::DOUBLE ELSE value END AS value1, CASE WHEN kind IN ('hidden', 'visible') THEN kind = 'visible' ELSE visible END AS visible2
                    FROM (SELECT *, reports AND (fresh OR (ejob = job AND NOT over1)) AS live
                        FROM (SELECT *, reports AND ejob > job AS fresh
                            FROM (SELECT w.*, e.k AS k1, e.ts_ms, e.kind, e.job AS ejob, e.stage AS estage, e.within, e.elow, e.ehigh, e.kind NOT IN ('hidden', 'visible', 'end') AND e.job IS NOT NULL AS reports, coalesce(e.ts_ms > w.deadline, false) AS late,
                                    CASE WHEN e.ts_ms > w.deadline THEN w.deadline END AS ended0, CASE WHEN e.ts_ms > w.deadline THEN NULL ELSE w.deadline END AS left_, w.over OR coalesce(e.ts_ms > w.deadline, false) AS over1
                                FROM w JOIN (SELECT *, {band(0)} AS elow, {band(1)} AS ehigh FROM e) e ON e.client = w.client AND e.k = w.k + 1) a) b) c) d) f) g)
    SELECT client, ended AS ts_ms, ended_job AS job, 'timeout' AS what, ended_at AS permille FROM w WHERE ended IS NOT NULL
    UNION ALL SELECT w.client, e.ts_ms, w.job, w.what, w.told FROM w JOIN e USING (client, k) WHERE told IS NOT NULL"""

def until_of(events: DataFrame) -> int:
    return (events.agg(F.max("ts_ms")).first()[0] or 0) - DELAY_MS


@query(MACHINE)
def r2_r4_watched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = base(spark, sf_dir, WATCHED)
    return watchdog.watched(events, until_of(events))


@query(MACHINE)
def r4_r5_watchdog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the state machine with timers: the table as a stream of files, and a table that the stream writes."""
    events = base(spark, sf_dir, WATCHED)
    folder = f"{shared_folder(spark)}/quirefold-watchdog-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    watchdog.run_to_end(watchdog.watching(stream, f"{DELAY_MS} milliseconds"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(watchdog.SENT).parquet(f"{folder}/out")
