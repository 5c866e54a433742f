"""Streaming operators over files in several micro-batches, against the same in one batch."""

import itertools

import pytest
from pyspark.sql import functions as F

from millrace import streaming


@pytest.fixture
def batches(spark, tmp_path):
    """A stream of three files, one for each micro-batch, and its rows by user."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 12").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).orderBy("event_id").collect()
    third = len(rows) // 3 + 1
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    for i in range(3):
        spark.createDataFrame(rows[i * third : (i + 1) * third], schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    spark.conf.set(*streaming.ROCKSDB)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in*"))
    by_user = {u: list(g) for u, g in itertools.groupby(sorted(rows, key=lambda r: (r.user_id, r.event_id)), key=lambda r: r.user_id)}
    yield stream, by_user
    spark.conf.unset(streaming.ROCKSDB[0])


def run(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    streaming.finished(query, 120)
    return spark.table(name).collect()


def test_per_key_steps(spark, batches, tmp_path):
    stream, by_user = batches
    got = run(spark, streaming.deduplicate(stream, ["user_id"], ["event_id"], ["event_type"]), tmp_path, "deduplicated")
    want = [(u, r.event_id) for u, rows in by_user.items() for i, r in enumerate(rows) if i == 0 or r.event_type != rows[i - 1].event_type]
    assert sorted((r.user_id, r.event_id) for r in got) == sorted(want)
    got = run(spark, streaming.grouped(stream, ["user_id"], ["event_id"], "event_id", 3), tmp_path, "grouped")
    want = [(u, i // 3, [r.event_id for r in rows[i : i + 3]]) for u, rows in by_user.items() for i in range(0, len(rows) - 2, 3)]
    assert sorted((r.user_id, r.group_id, list(r.group)) for r in got) == sorted(want)


def test_scan_and_windows(spark, batches, tmp_path):
    stream, by_user = batches
    got = run(spark, streaming.scan(stream, ["user_id"], ["event_id"], "event_id", 0, lambda a, x: a + x, "long"), tmp_path, "scanned")
    want = [(u, s) for u, rows in by_user.items() for s in itertools.accumulate(r.event_id for r in rows)]
    assert sorted((r.user_id, r.scanned) for r in got) == sorted(want)
    got = run(spark, streaming.sliding(stream, ["user_id"], ["event_id"], "event_id", 2), tmp_path, "slid")
    want = [(u, i, [rows[i].event_id, rows[i + 1].event_id]) for u, rows in by_user.items() for i in range(len(rows) - 1)]
    assert sorted((r.user_id, r.pos, list(r.window)) for r in got) == sorted(want)


def test_take_and_split(spark, batches, tmp_path):
    stream, by_user = batches
    got = run(spark, streaming.take(stream, ["user_id"], ["event_id"], 2), tmp_path, "taken")
    assert sorted((r.user_id, r.event_id) for r in got) == sorted((u, r.event_id) for u, rows in by_user.items() for r in rows[:2])
    marked = stream.withColumn("starts", F.col("event_type") == "signup")
    got = run(spark, streaming.split_when(marked, ["user_id"], ["event_id"], "starts"), tmp_path, "split")
    want = []
    for u, rows in by_user.items():
        group = -1
        for i, r in enumerate(rows):
            group += i == 0 or r.event_type == "signup"
            want.append((u, r.event_id, group))
    assert sorted((r.user_id, r.event_id, r.group_id) for r in got) == sorted(want)


def test_windows_of_event_time(spark, batches, tmp_path):
    stream, by_user = batches
    got = run(spark, streaming.conflate(stream, "ts", "1 day", "1 hour", ["user_id"], n=F.count("*")), tmp_path, "conflated")
    assert 0 < sum(r.n for r in got) <= sum(map(len, by_user.values()))
    got = run(spark, streaming.sessions(stream, "ts", "1 day", "1 hour", ["user_id"], n=F.count("*")), tmp_path, "sessions")
    assert got and all(r.ended > r.started for r in got)


def test_tee(spark, batches, tmp_path):
    stream, by_user = batches
    seen = []
    query = streaming.tee(stream, str(tmp_path / "c_tee"), lambda df, i: seen.append(df.count()), lambda df, i: df.write.mode("append").parquet(str(tmp_path / "teed")))
    query.processAllAvailable()
    query.stop()
    n = sum(map(len, by_user.values()))
    assert sum(seen) == n == spark.read.parquet(str(tmp_path / "teed")).count()


@pytest.fixture
def timed_batches(spark, tmp_path):
    """A stream of rows (k, id, ts) in micro-batches of given times in seconds, key by key."""

    def make(*batches):
        schema = "k long, id long, ts timestamp"
        for i, rows in enumerate(batches):
            df = spark.createDataFrame([(k, j) for j, k in rows], "k long, s long").select("k", F.col("s").alias("id"), F.timestamp_seconds("s").alias("ts"))
            df.coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "t*"))

    spark.conf.set(*streaming.ROCKSDB)
    yield make
    spark.conf.unset(streaming.ROCKSDB[0])


SECOND = 1_000_000


def test_a_timer_closes_a_group_without_a_further_row(spark, timed_batches, tmp_path):
    """Key 1 has no row after the second batch: the watermark of key 2's rows closes its group."""
    stream = timed_batches([(100, 1), (101, 1), (102, 2)], [(104, 1), (105, 2)], [(200, 2)], [(300, 2)])
    got = run(spark, streaming.grouped_within(stream, ["k"], ["ts"], "ts", "1 second", "id", 10, 4 * SECOND), tmp_path, "within")
    found = sorted((r.k, r.group_id, r.started // SECOND, list(r.group)) for r in got)
    assert found == [(1, 0, 100, [100, 101]), (1, 1, 104, [104]), (2, 0, 102, [102, 105]), (2, 1, 200, [200])]


def test_idle_keys_end_and_begin_again(spark, timed_batches, tmp_path):
    stream = timed_batches([(10, 1), (12, 1), (12, 2)], [(50, 2)], [(60, 1), (100, 2)], [(200, 3)])
    got = run(spark, streaming.idle(stream, ["k"], ["ts"], "ts", "1 second", 20 * SECOND), tmp_path, "silent")
    assert sorted((r.k, r.since // SECOND, r.n) for r in got) == [(1, 12, 2), (1, 60, 1), (2, 12, 1), (2, 50, 1), (2, 100, 1)]


def test_delayed_rows_wait_for_their_time(spark, timed_batches, tmp_path):
    stream = timed_batches([(10, 1), (11, 1)], [(40, 2)], [(41, 1), (100, 2)])
    got = run(spark, streaming.delay(stream, ["k"], ["ts"], "ts", "1 second", 5 * SECOND, ["id"]), tmp_path, "late")
    assert sorted((r.k, r.id, r.left // SECOND) for r in got) == [(1, 10, 15), (1, 11, 20), (1, 41, 46), (2, 40, 45)]  # 100 leaves after all that is known


def test_two_streams(spark, timed_batches, tmp_path):
    whole = timed_batches([(1, 1), (2, 1), (4, 1)], [(7, 1), (8, 1)], [(10, 1), (13, 1), (900, 2)], [(901, 2)])
    odd, even = whole.where("k = 2 or id % 2 = 1"), whole.where("k < 2 and id % 2 = 0")
    got = run(spark, streaming.zipped(odd, even, ["k"], "id", "ts", "id"), tmp_path, "zip2")
    assert sorted((r.k, r.pos, r.left, r.right) for r in got) == [(1, 0, 1, 2), (1, 1, 7, 4), (1, 2, 13, 8)]
    got = run(spark, streaming.interleaved(odd, even, ["k"], "id", "ts", "id"), tmp_path, "turns")
    assert [(r.pos, r.src, r.id) for r in sorted(got, key=lambda r: r.pos) if r.k == 1] == [(0, 0, 1), (1, 1, 2), (2, 0, 7), (3, 1, 4), (4, 0, 13), (5, 1, 8)]
    got = run(spark, streaming.merged_sorted(odd, even, ["k"], "id", "ts", "1 second", "id"), tmp_path, "merge2")
    assert [(r.pos, r.id) for r in sorted(got, key=lambda r: r.pos) if r.k == 1] == list(enumerate([1, 2, 4, 7, 8, 10, 13]))


def test_keys_share_the_state_of_their_bucket(spark, timed_batches, tmp_path):
    """All keys in one bucket: each keeps its own state, numbers and timers; null and large keys stay what they are."""
    stream = timed_batches([(10, None), (11, 2**53 + 1), (12, 2**53)], [(13, None), (100, 2**53)], [(200, 7)], [(400, 7)])
    got = run(spark, streaming.timed(stream, ["k"], ["ts"], "ts", "1 second", ["id"], "n long, ids array<long>", lambda own, r: ((20_000 + r[0] * 1000, [*(own or []), r[0]]), []), lambda own, w: (None, [(len(own), own)]), buckets=1), tmp_path, "one_bucket")
    assert sorted((r.k or 0, r.n, list(r.ids)) for r in got) == [(0, 2, [10, 13]), (2**53, 2, [12, 100]), (2**53 + 1, 1, [11])]


def test_waiting_rows_arent_copied_for_each_row():
    """One side's rows all come before the other's: a step may not look at all that wait."""
    import time

    steps = {}

    def taken(df, keys, order, columns, schema, initial, step):
        steps["step"], steps["own"] = step, initial

    held = streaming.stepped, streaming.tagged
    streaming.stepped, streaming.tagged = taken, lambda *a: None
    try:
        streaming.zipped(type("S", (), {"dtypes": [("id", "bigint")]})(), None, ["k"], "id", "ts", "id")
    finally:
        streaming.stepped, streaming.tagged = held
    began, own, out = time.process_time(), steps["own"], []
    for src in (0, 1):
        for i in range(100_000):
            own, some = steps["step"](own, (src, i))
            out += some
    assert out == [(i, i, i) for i in range(100_000)] and time.process_time() - began < 20


def test_batches_of_several_files(spark, monkeypatch, tmp_path):
    from millrace import positions

    monkeypatch.setattr(positions, "CHUNK_ROWS", 100)
    rows = spark.range(1000, numPartitions=2).select("id", F.timestamp_seconds("id").alias("ts"))
    stream = streaming.replayed(rows, "id", 2, str(tmp_path / "replayed"))
    query = stream.writeStream.format("memory").queryName("several_files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    streaming.finished(query, None)
    assert [p["numInputRows"] for p in query.recentProgress] == [500, 500]
    assert len(list((tmp_path / "replayed").glob("batch=*/part-*"))) == 10


def test_replay_has_few_partitions_of_state(spark, tmp_path, monkeypatch):
    """Each partition costs a store, a worker and a commit in each micro-batch: there were as many as the session shuffles to."""
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    seen, own = [], streaming.finished
    monkeypatch.setattr(streaming, "finished", lambda query, timeout_s: (own(query, timeout_s), seen.extend(query.recentProgress)))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = streaming.replayed(rows, "ts", 2, str(tmp_path / "replayed"))
        got = streaming.played(streaming.grouped(stream, ["k"], ["id"], "id", 10), "grouped")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and spark.conf.get(streaming.CHANGELOG[0], "unset") != "true"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert {o["numShufflePartitions"] for p in seen for o in p["stateOperators"]} == {streaming.STATE_PARTITIONS}
    assert sorted(i for r in got.collect() for i in r.group) == [i for i in range(200) if i // 7 < (200 - i % 7 + 6) // 7 // 10 * 10]
