"""Replacement by owner with snapshots, texts by project, and late arrivals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioflow.sources import analyses
from folioflow.sources.snapshots import Conflict, SnapshotTable
from folioflow.streaming import ingest

ROWS = "document_id long, n int, text string"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/table", buckets=4)


def put(spark, table, rows, owners, **on):
    return table.replace(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(d,) for d in owners], "document_id long"), **on)


def got(table, at=None):
    return sorted(map(tuple, table.read(at).select("document_id", "n", "text").collect()))


def test_a_reader_keeps_its_snapshot(spark, table):
    first = put(spark, table, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], [1, 2])
    seen = table.read(first)
    second = put(spark, table, [(1, 0, "A")], [1, 2])
    assert sorted(r.text for r in seen.collect()) == ["a", "b", "c"] and got(table, first) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert got(table) == [(1, 0, "A")] and (first.number, second.number) == (1, 2)
    # a write from an older state, rows of others, and a commit that never came change nothing
    with pytest.raises(Conflict):
        put(spark, table, [(3, 0, "x")], [3], on=first)
    with pytest.raises(ValueError):
        put(spark, table, [(3, 0, "x")], [4])
    assert got(table) == [(1, 0, "A")] and table.numbers() == [1, 2]


def test_many_writes_and_compactions_equal_a_dictionary(spark, table):
    rng, want, states = random.Random(1), {}, []
    for step in range(7):
        owners = rng.sample(range(12), 4)
        new = {d: [(d, k, f"{step}") for k in range(rng.randint(0, 2))] for d in owners}
        put(spark, table, [r for rows in new.values() for r in rows] or [], owners)
        want |= new
        if step in (3, 6):
            before = table.snapshot()
            after = table.compact(most=2)
            assert max(map(len, after.layers.values())) <= 2 < max(map(len, before.layers.values()))
        states.append((table.snapshot(), sorted(r for rows in want.values() for r in rows)))
    for at, rows in states:
        assert got(table, at) == rows
    table.vacuum(keep=2)
    assert len(table.numbers()) == 2 and got(table) == states[-1][1]
    assert table.compact(most=50) == table.snapshot()


def test_texts_of_others_stay(spark, tmp_path):
    path = str(tmp_path / "texts")
    schema = "project_id long, document_id long, raw_text string, cleaned_text string"
    analyses.write_texts(spark.createDataFrame([(1, 10, "a", "a"), (1, 11, "b", "b")], schema), path)
    analyses.write_texts(spark.createDataFrame([(2, 20, "c", None)], schema), path)
    analyses.write_texts(spark.createDataFrame([(1, 11, "B", "B"), (1, 12, "d", "d")], schema), path)
    rows = spark.read.parquet(path).select("project_id", "document_id", "raw_text").collect()
    assert sorted(map(tuple, rows)) == [(1, 10, "a"), (1, 11, "B"), (1, 12, "d"), (2, 20, "c")]


def test_late_and_repeated_arrivals(spark, tmp_path):
    inbox, store, state = str(tmp_path / "inbox"), str(tmp_path / "chunks"), str(tmp_path / "state")
    row = lambda d, t, at: (d, f"Abstract\n{t} words", 1, None, at)

    def arrive(*rows):
        df = spark.createDataFrame(rows, "document_id long, raw_text string, page_count int, extraction_error string, arrived_at long")
        df.withColumn("arrived_at", F.timestamp_seconds("arrived_at")).coalesce(1).write.mode("append").parquet(inbox)
        ingest.ingest_stream(spark, inbox, store, state).awaitTermination()
        rows = analyses.read_chunks(spark, store).where("section_name = 'Abstract'").collect()
        return {r.document_id: r.text for r in rows}, len(rows)

    assert arrive(row(1, "second", 20), row(2, "other", 10)) == ({1: "second words", 2: "other words"}, 2)
    touched = spark.read.parquet(f"{store}/touched").count()
    assert arrive(row(1, "first", 15), row(1, "second", 20)) == ({1: "second words", 2: "other words"}, 2)
    assert spark.read.parquet(f"{store}/touched").count() == touched  # late ones aren't even processed
    assert arrive(row(1, "third", 30), row(2, "late", 5)) == ({1: "third words", 2: "other words"}, 2)
    # a restart from nothing takes all files again and ends in the same table
    ingest.ingest_stream(spark, inbox, store, str(tmp_path / "anew")).awaitTermination()
    rows = analyses.read_chunks(spark, store).where("section_name = 'Abstract'").collect()
    assert sorted((r.document_id, r.text) for r in rows) == [(1, "third words"), (2, "other words")]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/table", buckets=1)
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("document_id"), F.lit(0).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        table.replace(rows, rows.select("document_id"))
    finally:
        spark.conf.unset(key)
    files = list((tmp_path / "table" / "rows").glob("layer=*/bucket=0/*.parquet"))
    assert len(files) > 2  # one, when a bucket was one task
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))


def test_texts_of_arrivals_move_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(ingest, "scratch", lambda df, label, f=ingest.scratch: kept.append(df.columns) or f(df, label))
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "chunks")
    rows = [(d, f"Abstract\n{t} words", 1, None, at) for d, t, at in ((1, "b", 5), (1, "a", 5), (1, "z", None), (2, "only", None), (None, "none", 1), (-1, "none", 1))]
    df = spark.createDataFrame(rows, "document_id long, raw_text string, page_count int, extraction_error string, arrived_at long")
    df.withColumn("arrived_at", F.timestamp_seconds("arrived_at")).write.parquet(inbox)
    ingest.ingest_stream(spark, inbox, store, str(tmp_path / "state")).awaitTermination()
    rows = analyses.read_chunks(spark, store).where("section_name = 'Abstract'").collect()
    assert sorted((r.document_id, r.text) for r in rows) == [(1, "b words"), (2, "only words")]
    assert kept and all("raw_text" not in c for c in kept)  # texts went to a table and were read again
