"""Upkeep of state and indexes from streams."""

import datetime as dt
import os

import pytest

from lorekeep.operators import segments
from lorekeep.streaming import upkeep, watch

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(watch.PROVIDER[0], None)
    spark.conf.set(*watch.PROVIDER)
    yield spark
    spark.conf.set(watch.PROVIDER[0], before) if before else spark.conf.unset(watch.PROVIDER[0])


def run(spark, tmp_path, batches, **options):
    """What the stream gives out batch by batch; each list of (path, kind, seq, ms, content) is one file."""
    source, out = str(tmp_path / "in"), []
    for rows in batches:
        # the clock is a path that moves the watermark on
        spark.createDataFrame([(p, k, s, at(ms), c, at(ms)) for p, k, s, ms, c in rows], watch.CHANGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(watch.CHANGES).parquet(source)
        query = watch.settled(stream, late="0 seconds", **options).writeStream.outputMode("append").foreachBatch(lambda b, _: out.append([(r.path, r.kind, r.seq, r.content) for r in b.orderBy("path").collect() if r.path != "clock"]))
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return [x for x in out if x]


def test_bursts_settle_to_their_last_event_and_late_events_stay_out(rocks, tmp_path):
    tick = lambda n, ms: ("clock", "change", n, ms, None)
    batches = [
        [("a", "add", 1, 0, "v1"), ("a", "change", 3, 120, "v3"), ("a", "change", 2, 60, "v2"), ("b", "add", 1, 0, "b1"), tick(1, 200)],  # a burst
        [("a", "change", 4, 260, "v4"), ("b", "change", 2, 2, "b2"), tick(2, 300)],  # a is still being written
        [tick(3, 2_000)],
        [("a", "unlink", 5, 2_100, None), tick(4, 3_000)],
        [("a", "add", 4, 3_100, "old text"), ("b", "unlink", 9, 3_100, None), tick(5, 4_000)],  # late by its number: older than the unlink
        [("b", "change", 7, 4_100, "b7"), tick(6, 6_000)],
        [("a", "add", 6, 6_100, "new text"), tick(7, 8_000)],
    ]
    got = [x for batch in run(rocks, tmp_path, batches) for x in batch]
    assert [x for x in got if x[0] == "a"] == [("a", "change", 4, "v4"), ("a", "unlink", 5, None), ("a", "add", 6, "new text")]
    assert [x for x in got if x[0] == "b"] in ([("b", "add", 1, "b1"), ("b", "unlink", 9, None)], [("b", "change", 2, "b2"), ("b", "unlink", 9, None)])


def test_the_provider_is_asked_for(spark, tmp_path):
    if "RocksDB" in spark.conf.get(watch.PROVIDER[0], ""):
        pytest.skip("set by the session")
    stream = spark.readStream.schema(watch.CHANGES).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="providerClass"):
        watch.settled(stream)


def test_a_late_event_does_not_bring_a_deleted_note_back(spark, tmp_path):
    columns = "path string, kind string, seq long, mtime timestamp, content string"
    events = lambda *rows: spark.createDataFrame([(p, k, s, at(s * 1000), c) for p, k, s, c in rows], columns)
    write, folder = upkeep.batch_writer(str(tmp_path), keep="1 hour"), str(tmp_path)
    write(events(("a", "add", 1, "v1"), ("b", "add", 1, "b1")), 0)
    write(events(("a", "unlink", 5, None)), 1)
    write(events(("a", "add", 4, "old text"), ("b", "change", 6, "b2")), 2)
    assert [(r.path, r.content, r.revision) for r in upkeep.current(spark, folder).collect()] == [("b", "b2", 2)]
    write(events(("a", "add", 7, "again")), 3)
    assert {(r.path, r.content) for r in upkeep.current(spark, folder).collect()} == {("a", "again"), ("b", "b2")}
    write(events(("a", "unlink", 8, None)), 4)
    write(events(("c", "add", 9_000, "much later")), 5)
    assert {r.path for r in upkeep.snapshot(spark, folder).collect()} == {"b", "c"}  # the tombstone has gone


def test_files_that_are_no_text_are_quarantined_and_notes_are_indexed(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.md").write_text("# One\n\nalpha beta\n\n# Two\n\ngamma", encoding="utf-8")
    (root / "bad.md").write_bytes(b"alpha \xff\xfe")
    (root / "sub dir" / "b.md").write_text("alpha alone", encoding="utf-8")
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"))
    folder = str(tmp_path / "state")

    def run():
        upkeep.start(upkeep.file_events(spark, str(root), max_files=10), folder, str(tmp_path / "check"), index=index).awaitTermination()

    run()
    assert {r.path for r in upkeep.current(spark, folder).collect()} == {"a.md", "sub dir/b.md"}
    assert [r.path for r in upkeep.quarantined(spark, folder).collect()] == ["bad.md"]
    assert {(r.path, r.chunk_index) for r in index.words().search("alpha").collect()} == {("a.md", 1), ("sub dir/b.md", 0)}
    (root / "bad.md").write_text("alpha healed gamma", encoding="utf-8")
    (root / "a.md").write_text("nothing left", encoding="utf-8")
    (root / "c.md").write_text("gamma", encoding="utf-8")
    (root / "sub dir" / "b.md").unlink()
    os.utime(root / "a.md", (2e9, 2e9))
    os.utime(root / "bad.md", (2e9, 2e9))
    assert upkeep.sync(spark, str(root), folder, index) == {"updated": 2, "added": 1, "deleted": 1, "unreadable": 0}
    assert {r.path for r in index.words().search("alpha").collect()} == {"bad.md"} and upkeep.quarantined(spark, folder).count() == 0
    assert {r.path for r in index.words().search("gamma").collect()} == {"bad.md", "c.md"} and len(index.newest().segments) == 2
    assert upkeep.sync(spark, str(root), folder, index) == {}
    (root / "worse.md").write_bytes(b"\xff")
    with pytest.raises(ValueError, match="worse"):
        upkeep.sync(spark, str(root), folder, index, strict=True)
    assert {r.path for r in upkeep.current(spark, folder).collect()} == {"a.md", "bad.md", "c.md"}
