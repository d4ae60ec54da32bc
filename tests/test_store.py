"""The snapshot store under retries, kills and writers at one time; raw files; streams that keep what they have seen as state."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from dossier.sources import scratch, snapshots
from dossier.streaming import steps

ROWS = "workspace_id int, source_id bigint, snapshot_id bigint, content string, retrieved_at timestamp"


def some(spark, first, last, step=1):
    return spark.range(first, last, step).selectExpr("CAST(id % 3 AS INT) AS workspace_id", "id % 7 AS source_id", "id AS snapshot_id", "concat('c', id % 50) AS content", "TIMESTAMP '2024-01-01 00:00:00' AS retrieved_at")


DIGEST = lambda c: F.sha2(c, 256)


def held(store):
    return sorted(tuple(r) for r in store.read().select("workspace_id", "source_id", "content").collect())


def test_a_job_that_runs_again_adds_nothing(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    assert store.append(some(spark, 0, 400), DIGEST("content")) == 1
    first = held(store)
    assert store.append(some(spark, 0, 400), DIGEST("content")) == 1 and held(store) == first and len(first) == len(set(first))
    assert store.append(some(spark, 300, 2000), DIGEST("content")) == 2
    want = {(i % 3, i % 7, f"c{i % 50}") for i in range(2000)}
    assert held(store) == sorted(want) and store.read(1).count() == len(first)


def test_what_a_killed_job_has_left_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = snapshots.Store(spark, f"file://{tmp_path}/s")
    store.append(some(spark, 0, 100), DIGEST("content"))
    before = held(store)
    with monkeypatch.context() as m:
        m.setattr(snapshots.Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.append(some(spark, 100, 900), DIGEST("content"))
    assert held(store) == before and len(os.listdir(f"{tmp_path}/s/data")) == 2
    store.append(some(spark, 100, 900), DIGEST("content"))
    assert held(store) == sorted({(i % 3, i % 7, f"c{i % 50}") for i in range(900)})


def test_writers_at_one_time_never_double_a_row(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: snapshots.Store(spark, path).append(some(spark, k, 1200, 2), DIGEST("content")), [0, 1, 0, 1]))
    assert held(snapshots.Store(spark, path)) == sorted({(i % 3, i % 7, f"c{i % 50}") for i in range(1200)}) and max(done) == 2


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.HTML").write_bytes(b"<p>one\ntwo")
    (tmp_path / "b.pdf").write_bytes(bytes(range(256)))
    got = {r["source"].rsplit("/", 1)[1]: r for r in snapshots.read_files(spark, f"file://{tmp_path}/*").collect()}
    assert {k: (r["content_type"], r["n_bytes"]) for k, r in got.items()} == {"a.HTML": ("html", 10), "b.pdf": ("pdf", 256)} and bytes(got["b.pdf"]["content"]) == bytes(range(256))
    assert [r["content"] for r in snapshots.read_texts(spark, f"file://{tmp_path}/a.HTML").collect()] == ["<p>one\ntwo"]


def test_streams_keep_what_they_have_seen(spark, tmp_path):
    """Batches of several runs from one checkpoint: repeats of any age are dropped, and no batch reads the table."""
    seen = set()
    for k in range(4):
        some(spark, k * 90, k * 90 + 300).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        out = steps.unique_snapshots(stream, DIGEST("content"), folder=f"{tmp_path}/state")
        seen |= {(i % 3, i % 7, i % 50) for i in range(k * 90, k * 90 + 300)}
        assert out.count() == out.distinct().count() == len(seen)
    os.rename(f"{tmp_path}/state/table", f"{tmp_path}/state/elsewhere")
    some(spark, 0, 2000).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    more = steps.unique_snapshots(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), DIGEST("content"), folder=f"{tmp_path}/state")
    assert more.count() == len({(i % 3, i % 7, i % 50) for i in range(2000)} - seen)
    assert os.listdir(f"{tmp_path}/state/table") and os.path.exists(f"{tmp_path}/state/checkpoint/state")


def test_folders_are_removed_when_released(spark):
    folder = scratch.new_folder(spark)
    kept = scratch.written(spark.range(3), folder)
    assert kept.count() == 3 and os.path.exists(folder.removeprefix("file://"))
    scratch.release(spark)
    assert not os.path.exists(folder.removeprefix("file://")) and not [h for h in scratch._handed if h[0] is spark]
