"""What must hold at any size: plans that don't grow with the input's depth, and results against brute force."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from dossier.operators import discovery, logs, review, work


def plan_lines(df):
    return len(df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_a_walk_of_five_levels_has_the_plan_of_one(spark):
    rng = random.Random(3)
    seeds = spark.createDataFrame([(j, f"u{j}", "d", 0) for j in range(3)], "job_id bigint, url string, domain string, ord int")
    edges = [(f"u{rng.randrange(200)}", f"u{rng.randrange(200)}", rng.choice("dde"), k) for k in range(900)]
    links = spark.createDataFrame(edges, "src string, url string, domain string, pos int")

    def brute(depth, per_domain, per_job):
        out = []
        for job in range(3):
            level, seen, read = [((0,), f"u{job}")], {f"u{job}"}, []
            for step in range(depth + 1):
                kept = sorted(level)[: max(0, per_domain - len(read))][: max(0, per_job - len(read))]
                read += [(job, u, step) for _, u in kept]
                found = {}
                for at, u in kept:
                    for src, to, domain, pos in edges:
                        if src == u and domain == "d" and to not in seen:
                            found[to] = min(found.get(to, ((1 << 60,),)), ((*at, pos),))
                seen |= found.keys()
                level = [(at, u) for u, (at,) in found.items()]
            out += read
        return sorted(out)

    sizes = []
    for depth in (1, 5):
        walk = discovery.crawl_frontier(seeds, links, depth=depth, per_domain=40, per_job=35)
        assert sorted(map(tuple, walk.select("job_id", "url", "depth").collect())) == brute(depth, 40, 35)
        assert all(sorted(r["places"]) == list(range(1, len(r["places"]) + 1)) for r in walk.groupBy("job_id").agg(F.collect_list("place").alias("places")).collect())
        sizes.append(plan_lines(walk))
    assert sizes[0] == sizes[1]


def test_names_within_names(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9))).strip() or "a"
    short, long = ({(rng.randrange(2), word()) for _ in range(120)} for _ in range(2))
    frame = lambda rows: spark.createDataFrame(sorted(rows), "workspace_id int, name string")
    got = logs.names_within(frame(short), frame(long)).collect()
    assert sorted(map(tuple, got)) == sorted((w, s, x) for w, s in short for v, x in long if v == w and s in x)


def test_events_are_composed_in_blocks(spark):
    rng = random.Random(7)
    events = [(t, k, rng.choice(["claim", "claim", "release", "complete", "reopen", "unknown"]), f"U{rng.randrange(4)}") for t, n in enumerate([1, 2, 7, 64, 65, 700]) for k in range(n)]
    want = {}
    for t, _, action, actor in sorted(events):
        status, who, version, refused = want.get(t, ("open", None, 1, 0))
        allowed, leads = review.ACTIONS.get(action, ((), None))
        if allowed is not None and status not in allowed:
            want[t] = (status, who, version, refused + 1)
        else:
            want[t] = (leads, actor if action == "claim" else None if action == "release" else who, version + 1, refused)
    df = spark.createDataFrame(rng.sample(events, len(events)), "task_id int, seq int, action string, actor string")
    for block in (64, 4):
        assert {r["task_id"]: tuple(r)[1:] for r in review.fold_reviews(df, block).collect()} == want


def test_a_task_of_very_many_events(spark):
    events = spark.range(300_000).selectExpr("IF(id % 10 = 0, id, 1) AS task_id", "id AS seq", "IF(id % 3 = 0, 'claim', 'release') AS action", "concat('U', id % 7) AS actor")
    row = review.fold_reviews(events).where("task_id = 1").first()
    assert row["row_version"] + row["n_refused"] == 270_001 and row["status"] == "open"


def test_counters_read_a_log_once(spark, tmp_path):
    rows = [(a, b, c) for a in ("x", None) for b in "pq" for c in (1, 2, 3) for _ in range(len(b) + c)]
    spark.createDataFrame(rows, "a string, b string, c int").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    sets = {"all": ["a", "b", "c"], "b": ["b"], "again": ["b"], "ca": ["c", "a"]}
    out = work.counters({name: (log, labels) for name, labels in sets.items()})
    value = lambda r, x: dict(zip("abc", r, strict=True))[x]
    want = Counter((name, ",".join(f"{x}={'' if value(r, x) is None else value(r, x)}" for x in labels)) for name, labels in sets.items() for r in rows)
    assert {(r["metric"], r["labels"]): r["n"] for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2  # one scan, said again in the initial plan
