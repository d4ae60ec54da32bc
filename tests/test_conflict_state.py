"""Conflicts as keyed state against the batch operators: orders of events, restarts, late first facts, reopening."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import facts
from dossier.streaming import conflict_state, steps

KEY = list(facts.FACT_KEY)
FACT = "workspace_id int, company_id string, fact_id bigint, field_key string, context_key string, value_type string, value_json string, fact_status string"
EVENT = FACT + ", action string, seq bigint"


def some_facts(n=160, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        field = rng.choice(["size.office_count", "identity.legal_name", "overview.hq_address"])
        kind, value = ("integer", str(rng.choice([100, 104, 120, 0]))) if field == "size.office_count" else ("string", json.dumps(rng.choice(["Riser", " riser", "Riser Group", "Other"])))
        rows.append((1, f"C{rng.randrange(6)}", i, field, "", kind, value, rng.choice(["candidate", "accepted", "candidate", "rejected"])))
    return rows


def found(spark, parts, tmp_path, schema=FACT):
    """The stream's table after batches that come one after the other, each by a new run from the checkpoint."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = steps.conflicts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), folder=f"{tmp_path}/state")
    return out


def test_any_order_and_restarts_give_the_batch_result(spark, tmp_path):
    rows = some_facts()
    want = sorted(map(tuple, facts.detect_conflicts(spark.createDataFrame(rows, FACT)).select(*KEY, "n_facts", "n_differing", "materiality").collect()))
    assert len(want) > 8
    shuffled = random.Random(1).sample(rows, len(rows))
    for k, order in enumerate((rows, rows[::-1], shuffled)):
        got = found(spark, [order[:60], order[60:61], order[61:]], f"{tmp_path}/{k}").where("n_differing > 0").select(*KEY, "n_facts", "n_differing", "materiality")
        assert sorted(map(tuple, got.collect())) == want


def test_closed_conflicts_open_again_as_in_batch(spark, tmp_path):
    rows = some_facts(240, 9)
    old, new = [r for r in rows if r[2] % 5], [r for r in rows if not r[2] % 5]
    members = facts.attached(spark.createDataFrame(old, FACT)).select(*KEY, "fact_id")
    close = [(*k, "resolved") for k in {tuple(r[:4]) for r in members.collect()}]
    decisions = [(w, c, None, f, x, None, None, None, status, 2) for w, c, f, x, status in close]
    got = found(spark, [[(*r, None, 1) for r in old], decisions, [(*r, None, 3) for r in new]], tmp_path, EVENT).where("status = 'reopened'").select(*KEY, "first_new", "n_new")
    conflicts = members.select(*KEY).distinct().withColumn("conflict_id", F.xxhash64(*KEY)).withColumn("status", F.lit("resolved"))
    held = members.join(conflicts, KEY).select("conflict_id", "fact_id")
    want = facts.reopen_conflicts(conflicts, held, spark.createDataFrame(rows, FACT)).join(conflicts.drop("status"), "conflict_id").select(*KEY, "first_new", "n_new")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 4


def test_a_rejected_fact_goes_and_another_leads(spark, tmp_path):
    own = lambda i, value, status="candidate": (1, "C", i, "size.office_count", "", "integer", value, status)
    got = found(spark, [[own(1, "5"), own(2, "20"), own(3, "20")], [own(1, "5", "rejected")], [own(4, "20"), own(2, "30")]], tmp_path)
    row = got.first()
    # the second leads and says 30 at last, from which the other two differ
    assert (row["n_facts"], row["n_differing"], row["status"]) == (3, 2, "open")


@pytest.mark.parametrize("field", ["identity.legal_name", "size.office_count"])
def test_values_differ_as_the_expression_says(spark, field):
    values = [("string", json.dumps(x)) for x in ("Riser", " rISER ", "Riser Group", "", "Ünï x", "5")] + [("integer", "5"), ("number", "5.2"), ("number", "0"), ("integer", "0"), ("boolean", "true"), ("boolean", "false"), ("json", '{"b":1,"a":[2]}'), ("json", '{"a":[2],"b":1}'), ("list", "[]"), ("string", None)]
    pairs = [(k, a, l, b) for k, a in values for l, b in values]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, k string, a string, l string, b string")
    said = facts.materially_different(F.lit(field), F.col("k"), F.col("a"), F.col("l"), F.col("b"))
    want = {r["i"]: bool(r["d"]) for r in df.select("i", said.alias("d")).collect()}
    assert {i: conflict_state.differ(field, *p) for i, p in enumerate(pairs)} == want
