import datetime as dt

from slatewing.streaming import events as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def rows(n):
    return [(i % (n - 3), i % 4, T0 + dt.timedelta(minutes=17 * (i % (n - 3))), float(i % 5)) for i in range(n)]


def run(spark, tmp_path, transform, mode):
    folder, out = str(tmp_path / "in"), []
    spark.createDataFrame(rows(60), SCHEMA).coalesce(1).write.parquet(folder)
    q = S.replay(spark, folder, SCHEMA, transform, lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "c"), "t", mode)
    q.awaitTermination(120)
    return sorted(out)


def test_dedup_stream_equals_batch(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.unique(s, "event_id", "ts", "30 days"), "append")
    assert sorted(r[0] for r in got) == sorted({r[0] for r in rows(60)})


def test_windows_stream_equals_batch(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.tumbling(s, "ts", "1 hour", ["user_id"]), "complete")
    want = sorted(map(tuple, S.tumbling(spark.createDataFrame(rows(60), SCHEMA), "ts", "1 hour", ["user_id"]).collect()))
    assert got == want


def test_sessions_stream_equals_batch(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.sessions(s, "ts", "90 minutes", "user_id", "1 minute"), "complete")
    want = sorted(map(tuple, S.sessions(spark.createDataFrame(rows(60), SCHEMA), "ts", "90 minutes", "user_id").collect()))
    assert got == want


def test_failing_subscriber_ends_alone(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows(10), SCHEMA).write.parquet(folder)

    def broken(df, _):
        raise RuntimeError("gone")

    seen = []
    bad = S.replay(spark, folder, SCHEMA, lambda s: s, broken, str(tmp_path / "a"), "bad")
    good = S.replay(spark, folder, SCHEMA, lambda s: s, lambda df, _: seen.append(df.count()), str(tmp_path / "b"), "good")
    good.awaitTermination(120)
    try:
        bad.awaitTermination(120)
    except Exception as e:  # noqa: BLE001
        assert "gone" in str(e)
    assert sum(seen) == 10
