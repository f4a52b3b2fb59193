"""Upload decisions in batch and as a stream against a fold in Python, and the limiter's busy stretches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quill.operators import state
from quill.streaming.uploads import upload_stream

SCHEMA = "token string, at double, seq long, action string, page long"


def folded(events, idle=1200):
    out, live = {}, {}
    for token, at, seq, action, page in sorted(events, key=lambda e: (e[1], e[2])):
        s = live.get(token)
        if action == "upload":
            live[token], ok = {"used": at, "armed": False, "page": None}, True
        elif s is None or at - s["used"] > idle:
            live.pop(token, None)
            ok = False
        else:
            s["used"], ok = at, True
            if action in ("arm", "done"):
                s["armed"] = action == "arm"
            elif action == "append":
                ok = s["armed"]
            elif action == "wait":
                s["page"] = page
            elif action == "submit":
                ok = s["page"] is not None and s["page"] == page
                s["page"] = None if ok else s["page"]
        out[token, seq] = ok
    return out


def random_events(n=400):
    r = random.Random(9)
    at, out = 1.0, []
    for seq in range(n):
        at += r.choice([0, 1, 60, 400, 700])
        out.append((r.choice("abc"), at, seq, r.choice(["upload", *state.ACTIONS]), r.randint(1, 2)))
    return out


EDGES = [("x", 5.0, 9001, "upload", None), ("x", 1205.0, 9002, "arm", None), ("x", 2405.5, 9003, "append", None), ("y", 5.0, 9004, "upload", None), ("y", 1205.0, 9005, "arm", None), ("y", 2405.0, 9006, "append", None), ("z", 6.0, 9007, "append", None)]


def test_batch(spark):
    events = random_events() + EDGES
    got = {(r.token, r.seq): r.accepted for r in state.upload_decisions(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == folded(events)
    # An upload is gone strictly after 20 minutes.
    assert not got["x", 9003] and got["y", 9006] and not got["z", 9007]
    assert state.upload_decisions(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream(spark, rocks, tmp_path):
    """Batches in order of time decide as one would; states go once the watermark has passed them."""
    events = sorted(random_events(200) + EDGES, key=lambda e: (e[1], e[2]))
    for k in range(4):
        part = events[k * len(events) // 4 : (k + 1) * len(events) // 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    spark.createDataFrame([("end", events[-1][1] + 9000, 0, "upload", 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in4"))
    (tmp_path / "all").mkdir()
    for k in range(5):
        source = next((tmp_path / f"in{k}").glob("*.parquet"))
        source.rename(tmp_path / "all" / f"{k}.parquet")
        os.utime(tmp_path / "all" / f"{k}.parquet", (1e9 + k, 1e9 + k))  # files are read in order of age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    run = upload_stream(stream).writeStream.format("memory").queryName("uploads").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(200)
    got = {(r.token, r.seq): r.accepted for r in spark.table("uploads").filter("token != 'end'").collect()}
    assert got == folded(events)
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # what is left is the last token's


def test_limiter_deals_a_hot_key_to_several_tasks(spark):
    """Bursts of a key, a window or more apart, are judged apart, with the decisions of one pass."""
    times = [float(burst * 5000 + i % 7 * 9) for burst in range(200) for i in range(20)]
    rows = [("hot", t) for t in times] + [(f"k{i}", float(i)) for i in range(2000)] + [(None, float(i * 61)) for i in range(50)]
    frame = spark.createDataFrame(rows, "key string, at double")
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny partitions would be put together
    spark.conf.set(name, False)
    got = state.limit_requests(frame, ["key"], 3, 60).withColumn("task", F.spark_partition_id()).toPandas()
    spark.conf.unset(name)
    hot = got[got["key"] == "hot"].sort_values(["at", "allowed"], ascending=[True, False])
    live, want = [], []
    for t in sorted(times):
        live = [x for x in live if x > t - 60]
        want.append(len(live) < 3)
        if want[-1]:
            live.append(t)
    assert hot["allowed"].tolist() == [w for _, w in sorted(zip(sorted(times), want), key=lambda x: (x[0], not x[1]))]
    assert hot["task"].nunique() > 1 and got["key"].isna().sum() == 50
