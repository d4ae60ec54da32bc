"""What must hold for a query's cost to grow no faster than its input: how work is dealt, and what is worked out once."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossier.functions import url
from dossier.operators import discovery, logs, review, work
from dossier.plans import registry
from dossier.plans.bindings import bound
from dossier.streaming import conflict_state, steps

SF = "/root/testdata/sf0.001"


def test_rows_that_become_long_texts_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert bound(spark, SF, "b_news_response").rdd.getNumPartitions() < cores
    dealt = bound(spark, SF, "b_news_response", dealt=True)
    assert dealt.rdd.getNumPartitions() == 4 * cores and dealt.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_news_items_resolve_an_address_once(spark):
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(split(")
    rows = bound(spark, SF, "b_news_response")
    assert 0 < steps(discovery.news_items(rows)) <= steps(rows.select(url.resolve(F.concat(F.lit("/"), "company_id"), F.col("url"))))


def test_review_events_are_summed_up_by_one_sort_without_lists(spark):
    plan = review.fold_reviews(bound(spark, SF, "b_review_event"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Scan parquet" in plan  # no table on the way either


def test_review_states_of_batches_follow_each_other(spark, tmp_path):
    rng, state, parts = random.Random(3), {}, []
    for _ in range(4):
        parts.append([(t, rng.randrange(50), rng.choice(["claim", "claim", "release", "complete", "reopen", "odd"]), f"U{rng.randrange(4)}") for t in range(30) for _ in range(rng.choice([0, 1, 2, 5]))])
        for t, _, action, actor in sorted(parts[-1]):
            status, who, version, refused = state.get(t, ("open", None, 1, 0))
            allowed, leads = review.ACTIONS.get(action, ((), None))
            if allowed is not None and status not in allowed:
                state[t] = (status, who, version, refused + 1)
            else:
                state[t] = (leads, actor if action == "claim" else None if action == "release" else who, version + 1, refused)
    kinds = "task_id bigint, seq int, action string, actor string"
    for rows in parts:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = steps.review_states(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), folder=f"{tmp_path}/state")
    assert {r["task_id"]: tuple(r)[1:] for r in out.collect()} == state


class _Pages:
    """A map state that counts its calls."""

    def __init__(self):
        self.kept, self.reads, self.writes = {}, 0, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.kept.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self.kept[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.kept[key]


def test_fields_of_conflicts_share_a_call_and_are_read_once(monkeypatch):
    events = lambda ids, status="candidate": pd.DataFrame([(1, f"C{c}", "size.office_count", "", 1, str(i), "integer", str(i % 4 * 50), status, None) for c in range(50) for i in ids], columns=["workspace_id", "company_id", "field_key", "context_key", "seq", "fact_id", "value_type", "value_json", "fact_status", "action"])
    results = []
    for page in (1 << 20, 64):
        monkeypatch.setattr(conflict_state, "PAGE", page)
        state, step = _Pages(), conflict_state.Conflicts()
        step.init(state)
        for batch in (events(range(40)), events(range(40, 44)), events(range(3, 44), "rejected")):
            (out,) = step.handleInputRows((7,), iter([batch[:9], batch[9:]]), None)
            results.append((page, out.astype(object).values.tolist()))
        if page > 64:
            assert (state.reads, state.writes) == (150, 150)
    assert [r for p, r in results if p == 64] == [r for p, r in results if p > 64]
    assert [r[0][4:6] for _, r in results[:3]] == [[40, 30], [44, 33], [3, 2]]
    assert len(state.kept) < 50 * 12  # pages that a shorter text no longer needs are gone


@pytest.mark.parametrize("name", ["c14_l4_nested_redacted", "l4_redacted_audit", "c7_json_paths", "a5_wiki_items", "a6_news_items"])
def test_registered_queries_deal_their_small_tables(spark, name):
    assert "Repartition" in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_duplicate_pairs_are_made_once_and_never_sorted_out(spark):
    # one name with many companies, one of them found by both numbers and by its name, one merged: each pair once
    kind = "workspace_id int, {} string, company_name string, tax_id string, registration_number string"
    new = spark.createDataFrame([(1, "N1", "Node Ltd", "7", "8"), (1, "N2", "Other", "7", None), (1, "N3", "", None, "9")], kind.format("new_id"))
    rows = [(1, f"C{i:04}", "Node" if i % 2 else "Node Two", "7" if i < 2 else None, "8" if i < 2 else "9" if i == 5 else None, "merged" if i in (0, 5) else "draft") for i in range(2500)]
    found = logs.duplicate_candidates(new, spark.createDataFrame(rows, kind.format("company_id") + ", status string"))
    got = [(r["new_id"], r["company_id"], r["score"]) for r in found.collect()]
    want = {("N1", r[1]): 1.0 if r[3] else 0.85 if r[2] == "Node" else 0.65 for r in rows if r[5] != "merged"} | {("N1", "C0000"): 1.0, ("N2", "C0000"): 1.0, ("N3", "C0005"): 1.0}
    assert sorted(got) == sorted((*k, v) for k, v in want.items())
    plan = registry.QUERIES["g2_duplicate_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "replace(" not in plan.lower()  # no name is normalized for each pair
    assert plan.index("Union") < plan.index("Aggregate")  # pairs aren't made distinct


@pytest.mark.parametrize("name", ["f9_corroborate", "f7_f8_f9_corroborated_scores"])
def test_corroboration_deals_rows_in_parts_that_no_core_count_bounds(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and plan.count("ENSURE_REQUIREMENTS") <= 5  # evidence is dealt once, a field's counts aren't dealt again
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_exports_deal_fields_and_evidence_once_and_read_a_document_once(spark):
    plan = registry.QUERIES["a9_json_exports"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(l_orderkey" in line for line in hashed) == 2 and sum("ENSURE_REQUIREMENTS" in line for line in hashed) <= 2  # the others are of versions
    assert "get_json_object" not in plan


@pytest.mark.parametrize("name", ["k1_assemble_drafts", "k6_published_values", "k6_published_versions"])
def test_drafts_and_published_values_read_facts_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [o_orderkey") == 1  # that of the last is for b_version, as its values are written before
    assert name != "k6_published_values" or "lambda" not in plan


def test_values_of_companies_that_nothing_keeps_back(spark):
    kind = "workspace_id int, company_id string, field_key string, context_key string, fact_id int, value_type string, value_json string, fact_status string, authority_tier int, support_type string, observed_at timestamp, origin_type string, hint decimal(5,2)"
    fact = lambda company, field, i, value, status="candidate", tier=1: (1, company, field, "", i, "string", f'"{value}"', status, tier, "direct", None, "reviewer", None)
    name, tax = "identity.legal_name", "identity.tax_id"
    rows = [
        fact("A", name, 1, "Node", tier=2), fact("A", name, 2, "node Corp", "accepted"), fact("A", name, 3, "node Corp"), fact("A", tax, 4, "7"), fact("A", "x", 5, "a"), fact("A", "x", 6, "b"), fact("A", "y", 7, "c", "superseded"),
        fact("B", name, 11, "Node"), fact("B", tax, 12, "7"), fact("B", tax, 13, "8", "superseded"),  # in conflict
        fact("C", name, 21, "Node"), fact("C", tax, 22, "7", "superseded"), fact("C", "x", 23, "a"),  # one is missing
        fact("D", name, 31, "Node"), fact("D", tax, 32, "7"), fact("D", tax, 33, "8", "rejected"), fact("E", name, 41, "Node"), fact("E", tax, 42, "7"),
    ]
    companies = spark.createDataFrame([(1, c) for c in "ABCD"], "workspace_id int, company_id string")
    found = work.publishable_values(companies, spark.createDataFrame(rows, kind), F.lit("2001-01-01").cast("timestamp"), (name, tax))
    got = {(r["company_id"], r["fact_id"], r["display_status"]) for r in found.collect()}
    assert got == {("A", 2, "verified"), ("A", 4, "inferred"), ("A", 5, "inferred"), ("D", 31, "inferred"), ("D", 32, "inferred")}
