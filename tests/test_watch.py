import datetime as dt

from graphquarry.streaming import watch as W

T = dt.datetime(2024, 1, 1)


def at(hours):
    return T + dt.timedelta(hours=hours)


def replay(spark, tmp_path, schema, batches, run):
    """Each list of rows as a batch of its own; what run made of them, in order."""
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = run(s).writeStream.foreachBatch(lambda d, _: got.extend((n, *r) for r in d.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return got


def test_probe(spark, tmp_path):
    """First scan, nothing new, a newer file, its own folder, an unreadable time; a restart goes on from the state."""
    schema = "root string, path string, modified timestamp, scanned timestamp"
    scan = lambda hour, *files, root="r": [(root, p, m, at(hour)) for p, m in files]
    batches = [
        scan(1, ("a", at(0)), ("b", at(0.5))), scan(2, ("a", at(0)), ("b", at(0.5))), scan(3, ("a", at(2.5)), ("b", at(0.5))) + scan(3, ("x", at(0)), root="q"), scan(4, ("a", at(2.5)), (".kb/index", at(3.9))),
        scan(5, ("a", None)) + scan(6, ("a", at(2.5))), scan(4.5, ("a", at(4.4))),
    ]
    got = replay(spark, tmp_path, schema, batches, lambda s: W.probe(s, delay="10 hours"))
    found = [(n, r, (s - T).total_seconds() / 3600, c) for n, r, s, c in got]
    assert sorted(found) == sorted([(0, "r", 1, True), (1, "r", 2, False), (2, "r", 3, True), (2, "q", 3, True), (3, "r", 4, False), (4, "r", 5, True), (4, "r", 6, False), (5, "r", 4.5, False)])


def test_signals_expire_by_the_streams_time(spark, tmp_path):
    schema = "directory string, created timestamp, deleted boolean, seen timestamp"
    batches = [
        [("a", at(0), False, at(0)), ("b", at(0), None, at(0)), ("c", None, False, at(0)), ("d", at(-100), False, at(0))],
        [("b", at(0), True, at(20)), ("e", at(19), False, at(20)), ("a", at(15), False, at(18))],
        [("z", at(60), False, at(60))],
        [("z", at(60), False, at(100))],
        [("late", at(0), False, at(1)), ("z", at(60), True, at(101))],
    ]
    got = replay(spark, tmp_path, schema, batches, lambda s: W.expiring(s, ttl_hours=24, delay="1 hour"))
    found = sorted((d, why) for _, d, _, why in got)
    assert found == [("a", "expired"), ("c", "unreadable"), ("d", "expired"), ("e", "expired"), ("z", "expired")]
    assert next(n for n, d, _, _ in got if d == "a") >= 2
