import datetime as dt

from marginalia.streaming import events as E


def rows():
    t = dt.datetime(2024, 1, 1)
    return [(i, t + dt.timedelta(hours=7 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(40)]


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(rows(), E.SCHEMA).write.parquet(f"{tmp_path}/in")
    for f, name in ((E.windowed_counts, "counts"), (E.sessions, "sessions")):
        q = f(E.read(spark, f"{tmp_path}/in")).writeStream.outputMode("append" if name == "sessions" else "complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        got = {tuple(r) for r in spark.sql(f"select * from {name}").collect()}
        want = {tuple(r) for r in f(spark.createDataFrame(rows(), E.SCHEMA)).collect()}
        assert got == want if name == "counts" else got <= want
