"""Queries that run the streaming steps over the tables as a stream of files, with SQL for their final tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from ..streaming import steps
from .bindings import bound
from .outputs import _FOLD
from .registry import _KEY, _MEMBERS, _in, query


@query("n1_stream_snapshots", "SELECT DISTINCT workspace_id, source_id, sha256(content) AS content_hash FROM b_snapshot")
def stream_snapshots(s, d):
    return steps.unique_snapshots(bound(s, d, "b_snapshot", stream=True), F.sha2("content", 256))


@query("n5_stream_audit", "SELECT date_trunc('hour', created_at) AS starts, action, count(*) AS n, count(*) FILTER (len(list_filter(json_keys(metadata_json), lambda k: regexp_matches(lower(k), 'api_key|secret|password|token|private_key'))) > 0) AS n_redacted FROM b_audit GROUP BY ALL")
def stream_audit(s, d):
    return steps.audit_counts(bound(s, d, "b_audit", stream=True))


@query("n2_stream_page_facts", "SELECT page_id, 'identity.legal_name' AS field_key, concat('\"N', page_id, '\"') AS value FROM b_marked_page")
def stream_page_facts(s, d):
    return steps.page_facts(bound(s, d, "b_marked_page", stream=True))


_LEVEL = f"CASE WHEN field_key IN {_in(facts.scoring.CRITICAL_FIELDS)} THEN 'critical' WHEN field_key IN {_in(facts.scoring.HIGH_FIELDS)} THEN 'high' ELSE 'medium' END"


@query("n3_stream_conflicts", f"SELECT {_KEY}, count(*) AS n_facts, count(*) FILTER (differs) AS n_differing, {_LEVEL} AS materiality FROM ({_MEMBERS.replace('b_fact', 'b_order_fact')}) GROUP BY {_KEY} HAVING count(*) FILTER (differs) > 0")
def stream_conflicts(s, d):
    return steps.conflicts(bound(s, d, "b_order_fact", stream=True)).where("n_differing > 0").select(*facts.FACT_KEY, "n_facts", "n_differing", "materiality")


_ATTACHED_BY = lambda where: (
    f"SELECT {_KEY}, fact_id FROM (SELECT *, bool_or(differs) OVER (PARTITION BY {_KEY}) AS any_differs FROM ({_MEMBERS.replace('b_fact', '(SELECT * FROM b_order_fact WHERE ' + where + ')')})) WHERE any_differs AND (differs OR role = 'primary')"
)
_CLOSED = f"SELECT * FROM ({_ATTACHED_BY('floor(fact_id / 3) % 3 <> 1')})"


@query(
    "n3_stream_reopened",
    f"WITH m AS ({_CLOSED}) SELECT {_KEY}, min(fact_id) AS first_new, count(*) AS n_new FROM ({_ATTACHED_BY('TRUE')}) SEMI JOIN m USING ({_KEY}) ANTI JOIN m USING ({_KEY}, fact_id) GROUP BY {_KEY}",
)
def stream_reopened(s, d):
    """All conflicts are closed before the last third of the facts arrives, earlier ones by their id among them."""
    return steps.conflicts(bound(s, d, "b_conflict_event", stream=True)).where("status = 'reopened'").select(*facts.FACT_KEY, "first_new", "n_new")


@query("n4_stream_reviews", _FOLD.replace("b_review_event", "b_order_event"))
def stream_reviews(s, d):
    return steps.review_states(bound(s, d, "b_order_event", stream=True))
