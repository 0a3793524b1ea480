"""Query of the change detector and its SQL."""

from __future__ import annotations

from ..operators import merkle
from ..session import table


def p1_changes(spark, d):
    """The files the next sync must process, with the kind of change."""
    return merkle.pending_files(table(spark, d, "scan_log"), table(spark, d, "file_state"), table(spark, d, "sync_runs"))


def p1_found(spark, d):
    return p1_changes(spark, d).select("source_path", "content_hash")


_SQL = """
    WITH c AS (
        SELECT source_path, content_hash FROM (
            SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY modified_time DESC NULLS LAST, received_at DESC NULLS LAST, obs_id DESC) AS rn
            FROM scan_log WHERE content_hash IS NOT NULL AND source_path IS NOT NULL) WHERE rn = 1
    ), s AS (
        SELECT path, content_hash FROM (
            SELECT f.path, f.content_hash, row_number() OVER (PARTITION BY f.path ORDER BY f.run_id DESC, f.mtime DESC NULLS LAST, f.content_hash DESC NULLS LAST) AS rn
            FROM file_state f JOIN (SELECT DISTINCT run_id FROM sync_runs WHERE status = 'ok') r ON f.run_id = r.run_id) WHERE rn = 1
    )
    SELECT c.source_path, c.content_hash{change} FROM c LEFT JOIN s ON c.source_path = s.path WHERE s.path IS NULL OR c.content_hash IS DISTINCT FROM s.content_hash
"""

QUERIES = {"p1_found": p1_found, "p1_changes": p1_changes}
ORACLES = {"p1_found": _SQL.format(change=""), "p1_changes": _SQL.format(change=", CASE WHEN s.path IS NULL THEN 'new' ELSE 'modified' END AS change")}
