"""Late events in a store by run."""

from rows import collected, event, frame

from runledger.operators.timeline import run_summary, timeline_index
from runledger.sources import tables as T
from runledger.streaming import jobs as J


def _files_read(df):
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_late_batch_reads_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    old = [event(100 * r + i, "custom", i, run=f"r{r}") for r in range(120) for i in range(1, 4)]
    late = [event(350, "run.start", 0, run="r3", arrival=10**6), event(301, "custom", 99, run="r3", arrival=10**6), event(9999, "custom", 5, run="fresh")]
    first, batch = frame(spark, old), frame(spark, late)
    T.store_events_by_run(first, path, 0)
    touched = J.rebuild_late_runs(batch, path, 1)
    expected = [*[e for e in old if e[1] == "r3"], late[0], late[2]]  # the copy of e301 came later
    whole = run_summary(timeline_index(frame(spark, expected)))
    assert collected(touched, *whole.columns) == collected(whole, *whole.columns)
    assert sorted({r["run_id"] for r in touched.collect()}) == ["fresh", "r3"]
    T.store_events_by_run(batch, path, 1)  # again
    kept = T.read_runs(spark, path, first.schema, batch)
    assert collected(kept, "id") == [("e301",), ("e302",), ("e303",), ("e350",), ("e9999",)]
    assert _files_read(T.scan_runs(spark, path, first.schema, batch)) <= 5 < 80 < _files_read(spark.read.parquet(path))


def test_empty_batches_and_runs_without_id(spark, tmp_path):
    path = str(tmp_path / "store")
    lost = frame(spark, [event(1, "custom", 0, run=None), event(2, "custom", 0, run="a")])
    T.store_events_by_run(lost, path, 0)
    T.store_events_by_run(lost.limit(0), path, 1)
    assert collected(T.read_runs(spark, path, lost.schema, lost.where("run_id IS NULL")), "id") == [("e1",)]
    assert T.read_runs(spark, path, lost.schema, lost.limit(0)).isEmpty()
