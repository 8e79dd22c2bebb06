"""Captured responses as a stream with an offset, and builds by a watermark with a grace."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spindrift.operators import rollup
from spindrift.plans.adapters import event_log
from spindrift.sources import capture
from spindrift.streaming import incremental

T0 = datetime(2024, 1, 31)


def feed(*ids):
    items = "".join(f"<item><guid>{i}</guid><title>Title {i}</title></item>" for i in ids)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>{items}</channel></rss>'


def put(path, connection, number, status, cursor, *ids):
    folder = path / str(connection)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{number}.json").write_text(json.dumps({"status": status, "etag": cursor, "body": feed(*ids) if ids else None}))


def test_captures_are_read_once_across_restarts(spark, tmp_path):
    """No item twice and none lost, though the query is started anew for each part, servers repeat themselves and
    a poll fails in between."""
    path, out, mark = tmp_path / "captures", str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        query = capture.feed_items(capture.stream(spark, str(path))).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["connection_id"], r["id"]) for r in spark.read.parquet(out).collect())

    put(path, 7, 0, 200, "a", "g1", "g2")
    put(path, 7, 1, 304, None)
    put(path, 8, 0, 500, None)
    assert run() == [(7, "g1"), (7, "g2")]
    put(path, 7, 2, 200, "a", "never")  # the cursor of what was read: nothing new
    put(path, 7, 3, 200, "b", "g2", "g3")
    put(path, 7, 4, 503, None)
    put(path, 8, 1, 200, "a", "g1")
    assert run() == [(7, "g1"), (7, "g2"), (7, "g3"), (8, "g1")]
    assert run() == [(7, "g1"), (7, "g2"), (7, "g3"), (8, "g1")]
    put(path, 7, 5, 200, "b", "never")
    put(path, 7, 6, 200, "c", "g4")
    assert run() == [(7, "g1"), (7, "g2"), (7, "g3"), (7, "g4"), (8, "g1")]


def test_offsets_hold_the_last_success(tmp_path):
    reader = capture.CaptureReader(str(tmp_path))
    assert reader.latestOffset() == {} and capture.CaptureReader(str(tmp_path / "none")).latestOffset() == {}
    put(tmp_path, 3, 0, 200, "x", "g")
    put(tmp_path, 3, 1, 404, "no")
    put(tmp_path, 10, 0, 500, None)
    (tmp_path / "notes").mkdir()
    (tmp_path / "3" / "4.part").write_text("{")
    end = reader.latestOffset()
    assert end == {"10": [0, None], "3": [1, "x"]}
    assert [p.connection for p in reader.partitions({"10": [0, None]}, end)] == ["3"]
    assert [r[1] for p in reader.partitions({}, end) for r in reader.read(p)] == [0]


def test_builds_move_a_watermark_and_wait_for_the_grace(spark, sf_dir, tmp_path):
    """Each tick builds what came in since the last, less the grace; a tick with nothing new builds nothing; in the
    end all is as if it had been built at once."""
    root, log = str(tmp_path), event_log(spark, sf_dir)
    late = log.limit(20).withColumns({"event_id": F.col("event_id") + 10**6, "stable_id": F.concat(F.lit("late"), "stable_id"), "ingest_time": F.lit(T0 - timedelta(seconds=60)).cast("timestamp_ntz")})
    every = log.unionByName(late)
    incremental.fold_batch(root, every, 0)
    schema = incremental._ddl(every)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    said = lambda df: sorted(map(str, df.select("cluster_id", "event_count", "last_event_time", "entities").collect()))
    then = T0 - timedelta(days=9)
    assert incremental.build_tick(spark, root, schema, at(then))
    assert said(incremental.built(spark, root)) == said(rollup.rollup(log.filter(F.col("ingest_time") <= at(then - timedelta(seconds=90)))))
    assert incremental.build_tick(spark, root, schema, at(T0))  # the late ones are within the grace
    assert said(incremental.built(spark, root)) == said(rollup.rollup(log))
    before = said(incremental.built(spark, root))
    assert not incremental.build_tick(spark, root, schema, at(T0)) and not incremental.build_tick(spark, root, schema, at(then))
    assert said(incremental.built(spark, root)) == before
    assert incremental.build_tick(spark, root, schema, at(T0 + timedelta(seconds=60)))
    assert said(incremental.built(spark, root)) == said(rollup.rollup(every))
