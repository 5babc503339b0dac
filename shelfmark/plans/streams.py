"""Streaming queries, run to the end of the supplied tables."""

from __future__ import annotations

from shelfmark.streaming import runs


def ss_error_windows(spark, sf_dir):
    return runs.drained(runs.error_windows(runs.read_table(spark, sf_dir, "events")), "update", ["window_start"])


def ss_dedupe_hash(spark, sf_dir):
    return runs.drained(runs.first_by_content(runs.read_table(spark, sf_dir, "documents")), "append", ["sha256"])


def ss_latest_state(spark, sf_dir):
    return runs.drained(runs.latest_state(runs.read_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type"), "update", ["user_id"])


QUERIES = {f.__name__: f for f in (ss_error_windows, ss_dedupe_hash, ss_latest_state)}

SQL = {
    "ss_error_windows": "WITH e AS (SELECT floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type = 'error'), w AS (SELECT s - unnest(range(12)) AS window_start FROM e) SELECT window_start, count(*) AS errors FROM w GROUP BY 1",
    "ss_dedupe_hash": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
    "ss_latest_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
}
