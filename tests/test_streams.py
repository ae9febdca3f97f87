"""Keeping the first reading on a stream whose copies arrive out of order, with restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridloom.operators.cleaning import keep_first
from gridloom.streaming.rollup import first_of_stream

SCHEMA = "household LONG, seen TIMESTAMP, _row STRING, seq LONG"
START = datetime(2024, 1, 1)


def test_first_in_order_over_files_and_restarts(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("source", "table", "state"))
    at = [START + timedelta(minutes=30 * i) for i in range(40)]
    # Each file covers the last two hours again, with smaller sequence numbers than the file before it.
    files = [[(h, t, f"{h}-{n}", None if t == at[2] and n == 1 else 100 * (9 - n) + h) for h in (1, 2) for t in at[4 * n : 4 * n + 8]] for n in range(4)]
    files[1] += [(1, at[7], "tie b", 5), (1, at[7], "tie a", 5), (1, None, "no time", 1), (None, at[7], "no household", 3)]
    files[2] += [(1, at[0], "far too late", -1)]
    files.append([(9, at[39], "last", 1)])
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Every file is a run of its own that goes on from the checkpoint of the one before.
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        first_of_stream(stream, ["household"], "seen", ["seq"], "3 hours").writeStream.format("parquet").option("path", table).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()
    every = spark.createDataFrame([r for rows in files for r in rows], SCHEMA).where("_row != 'far too late' and seen is not null")
    wanted = keep_first(every, ["household", "seen"], ["seq"]).where(F.col("seen") <= F.lit(at[39] - timedelta(hours=3)))
    found = spark.read.schema(SCHEMA).parquet(table)
    assert found.count() == 2 * 20 + 1
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert found.where("household = 1 and _row = 'tie a'").count() == 1
