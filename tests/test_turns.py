"""Turn chunks in one go, in steps and as a stream, and the sink that replaces by key."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from convolake.operators import chunking, turnchunks
from convolake.streaming import sinks
from convolake.streaming import turns as streamed

SCHEMA = "session string, seq long, role string, is_prompt boolean, text string, uuid string, ts string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(n_sessions=6, seed=1):
    rnd = random.Random(seed)
    out = []
    for s in range(n_sessions):
        for seq in range(rnd.randrange(1, 40)):
            role = rnd.choice(["user", "user", "assistant", "assistant", "tool_call", "tool_result", "summary"])
            text = rnd.choice([None, "", "  ", "short", "word " * rnd.randrange(1, 700), " padded "])
            uuid = rnd.choice([None, f"u{s}.{seq}"])
            out.append((f"s{s}", seq * 2 + 1, role, role == "user" and rnd.random() < 0.6, text, uuid, rnd.choice([None, f"2024-01-01T00:00:{seq:02d}Z"])))
    return out


def _plain(rows, quiet=None):
    """(session, seq_start, seq_end, uuid, ts, i, piece) by the row."""
    found = set()
    for s in sorted({r[0] for r in rows}):
        turns = streamed.turns([r[1:] for r in rows if r[0] == s])
        for turn in turns if quiet is None or s in quiet else turns[:-1]:
            uuid, ts = (next((r[k] for r in turn if r[k] is not None), None) for k in (4, 5))
            for i, piece in enumerate(chunking.split_text(streamed.turn_text(turn))):
                found.add((s, turn[0][0], turn[-1][0], uuid, ts, i, piece))
    return found


def _set(df):
    return set(map(tuple, df.select("session", "seq_start", "seq_end", "uuid", "ts", "i", "piece").collect()))


def test_batch_chunks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert _set(turnchunks.chunks(df)) == _plain(rows)
    quiet = spark.createDataFrame([("s0",), ("s3",), ("other",)], "session string")
    assert _set(turnchunks.chunks(df, quiet)) == _plain(rows, {"s0", "s3"}) < _plain(rows)
    assert len(_plain(rows)) > 25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_in_steps_end_as_in_one_go(spark, seed, tmp_path):
    rows = _rows(4, seed)
    rnd = random.Random(seed)
    ends = {s: sorted(rnd.sample(range(0, 80), 3)) + [1000] for s in sorted({r[0] for r in rows})}
    chunk = "session string, seq_start long, seq_end long, uuid string, ts string, i int, piece string"
    known, done = spark.createDataFrame([], chunk), spark.createDataFrame([], "session string, chunked_seq long")
    for step in range(4):
        seen = [r for r in rows if r[1] <= ends[r[0]][step]]
        quiet = {s for s in ends if step == 3 or rnd.random() < 0.5}
        df = spark.createDataFrame(seen, SCHEMA)
        new, gone, done = turnchunks.changes(df, done, spark.createDataFrame([(s,) for s in quiet] or [("-",)], "session string"))
        known = known.join(gone, ["session", "seq_start"], "left_anti").unionByName(new.select(known.columns))
        for name, table in (("known", known), ("done", done)):
            table.write.parquet(f"{tmp_path}/{name}{step}")
        known, done = (spark.read.parquet(f"{tmp_path}/{x}{step}") for x in ("known", "done"))
        assert _set(known) >= _plain(seen, quiet=set())
        assert {r["session"] for r in new.collect()} <= {r[0] for r in seen}
    assert _set(known) == _plain(rows)
    assert turnchunks.changes(df, done, df.select("session"))[0].collect() == []


def test_streamed_chunks_equal_batch_in_any_order(spark, tmp_path):
    rows = _rows(5, 3)
    rnd = random.Random(3)
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k in range(3):
            spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        told = streamed.turn_chunks(stream, quiet_ms=500).filter("NOT rebuild")
        write = sinks.replacing(f"{tmp_path}/out", ["session", "seq_start"], 4, F.size("pieces") == 0)
        query = told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp")
        query = query.trigger(processingTime="1 second").start()
        want = _plain(rows)
        for _ in range(60):
            query.awaitTermination(1)
            held = sinks.current(spark, f"{tmp_path}/out", told.schema)
            got = _set(held.select("*", F.posexplode("pieces").alias("i", "piece")))
            if got == want:
                break
        query.stop()
        assert got == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_a_sink_replaces_by_key_and_once(spark, tmp_path):
    schema = "ref string, i int, text string, dead boolean"
    path = f"{tmp_path}/t"
    write = sinks.replacing(path, ["ref"], 8, F.col("dead"))
    batches = [
        [(f"r{k}", i, f"a{k}.{i}", False) for k in range(20) for i in range(2)],
        [("r1", 0, "b", False), ("r1", 0, "b", False), ("r2", None, None, True), ("new", 0, "n", False)],
        [],
        [(f"r{k}", None, None, True) for k in range(20)],
        [(r, None, None, True) for r in ("new", "other")],
        [("last", 1, "x", False)],
    ]
    want: dict[str, set] = {}
    for number, rows in enumerate(batches):
        before = _files(path) if number else {}
        write(spark.createDataFrame(rows, schema), number)
        for ref in {r[0] for r in rows}:
            want.pop(ref, None)
        for r in rows:
            if not r[3]:
                want.setdefault(r[0], set()).add(r)
        got = sorted(map(tuple, sinks.current(spark, path, schema).collect()))
        assert got == sorted(r for rs in want.values() for r in rs)
        after = _files(path)
        assert {f: t for f, t in after.items() if f in before} == before  # nothing is touched in place
        write(spark.createDataFrame([("other", 0, "x", False)], schema), number)  # run again: it is known
        assert _files(path) == after
    small = [f for f in _files(path) if "rows/batch=1/" in f and f.endswith(".parquet") and "/bucket=" in f]
    assert len({f.split("bucket=")[1].split("/")[0] for f in small}) <= 3
    assert sinks.current(spark, f"{tmp_path}/none", schema).collect() == []


def test_upserts_keep_the_newest_and_touch_few_buckets(spark, tmp_path):
    path, schema = f"{tmp_path}/u", "key long, version long, text string"
    write = sinks.upserting(path, "key", "version", 16)
    write(spark.createDataFrame([(k, 5, "a") for k in range(40)], schema), 0)
    before = _files(path)
    write(spark.createDataFrame([(1, 4, "old"), (2, 5, "same"), (3, 6, "new"), (3, 7, "newer"), (99, 1, "more")], schema), 1)
    want = {k: (5, "a") for k in range(40)} | {3: (7, "newer"), 99: (1, "more")}
    assert {r["key"]: (r["version"], r["text"]) for r in sinks.current(spark, path, schema).collect()} == want
    after = _files(path)
    assert {f: t for f, t in after.items() if f in before} == before
    fresh = {f.split("bucket=")[1].split("/")[0] for f in after if f not in before and "bucket=" in f}
    assert len(fresh) <= 4


def test_rows_rewritten_meanwhile_are_skipped(spark):
    rows = spark.createDataFrame([("a", 1, "v"), ("b", 2, "v"), ("c", 3, "v")], "ref string, digest long, vector string")
    now = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "ref string, digest long")
    assert [r["ref"] for r in sinks.still_so(rows, now, ["ref"], "digest").collect()] == ["a"]
