from loomgraph.streaming import jobs


def test_retries_and_dead_letters(spark, tmp_path):
    rows = [(1, False, 0), (1, False, 10), (1, False, 20), (1, True, 30), (2, False, 0), (2, True, 5), (3, True, 1)]
    spark.createDataFrame(rows, "job_id bigint, ok boolean, at_ms bigint").write.parquet(str(tmp_path / "in"))
    stream = jobs.worker(spark.readStream.schema("job_id bigint, ok boolean, at_ms bigint").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.job_id, r.attempt, r.status, r.retry_at_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, "retry", 100), (1, 2, "retry", 210), (1, 3, "dead_letter", None), (2, 1, "retry", 100), (2, 2, "completed", None), (3, 1, "completed", None)]


def test_batch_folds(spark):
    log = spark.createDataFrame([(1, "enqueue", 0), (1, "enqueue", 1), (1, "complete", 1), (2, "enqueue", 0), (3, "enqueue", 0), (3, "dead_letter", 3)], "id bigint, op string, attempt int")
    assert [r.id for r in jobs.pending(log).collect()] == [2]
    assert tuple(jobs.counters(log).first()) == (3, 1, 1, 1)


def test_rerun_of_a_batch_writes_the_same(spark, tmp_path):
    batch = spark.createDataFrame([(1, "Rust and a graph"), (2, "rust")], "node_id bigint, content string")
    for _ in range(2):
        jobs.apply_jobs(batch, 7, [("Rust", "Language", 0.9), ("graph", "Topic", 0.8)], str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 2 and spark.read.parquet(str(tmp_path / "edges")).count() == 3


def test_durable_jobs(spark, tmp_path):
    from loomgraph.plans.ingest import default_models

    q = jobs.DurableJobs(spark, str(tmp_path / "jobs"), 2)
    assert q.pending().count() == 0 and q.run(default_models(), None) == 0
    rows = spark.createDataFrame([(1, "Rust and Graph", "mock-ner", "wal-lsn-1"), (2, "none", "topic-lite", "wal-lsn-1")], "node_id bigint, content string, model_id string, snapshot_id string")
    q.enqueue(rows)
    q.enqueue(rows.where("node_id = 1"))
    stored = []

    def failing(changes):
        raise OSError("busy")

    for left in (2, 0):
        try:
            q.run(default_models(), failing)
        except OSError:
            pass
        assert q.pending().count() == left
    assert tuple(jobs.counters(q.log()).first())[2:] == (0, 2)
    q.enqueue(spark.createDataFrame([(3, "an AI Database", "mock-ner", "wal-lsn-2")], rows.schema))
    assert q.run(default_models(), lambda c: stored.append(c.collect()) or 1) == 1 and q.pending().count() == 0
    assert sorted((r.op, r.op_idx) for r in stored[0]) == [("put", 0), ("put", 0), ("put_edge", 1), ("put_edge", 1)]
