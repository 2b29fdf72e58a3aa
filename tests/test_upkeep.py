"""Health rules, cascades, names, backfill, releases, line ranges, rate limits and prompts on hand-made rows."""

from __future__ import annotations

import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convolake import storage
from convolake.functions import redaction
from convolake.operators import activity, backfill, cascades, chunking, health, maintenance, retrieval, surface
from convolake.sources import transcripts
from convolake.streaming import sinks, tail

NOW = datetime(2026, 3, 1, 12)


def _health(spark, status, devices=(), conflicts=(), imports=(), drift=()):
    ago = lambda s: None if s is None else NOW - timedelta(seconds=s)
    tables = (
        ([(h, ago(w), ago(r), ago(b), ok, disk, n, ago(o)) for h, w, r, b, ok, disk, n, o in status],
         "hub string, written_at timestamp, last_reconcile_at timestamp, started_at timestamp, reachable boolean, disk_free_gb double, pending_chunks long, oldest_pending_ts timestamp"),
        ([(h, n, c, ago(s)) for h, n, c, s in devices], "hub string, name string, connected boolean, last_seen timestamp"),
        (list(conflicts), "hub string, path string"),
        ([(h, ago(s)) for h, s in imports], "hub string, ingested_at timestamp"),
        (list(drift), "hub string, category string, value string, n long"),
    )
    found = health.warnings(*[spark.createDataFrame(rows, schema) for rows, schema in tables], F.lit(NOW))
    return {(r["hub"], r["rule"], r["subject"], r["seconds"], r["n"]) for r in found.collect()}


def test_each_health_rule_fires_and_none_when_all_is_well(spark):
    well = ("well", 60, 600, 9000, True, 500.0, 0, None)
    ill = ("ill", 601, 3601, 9000, False, 29.9, 7, 86401)
    dead = ("dead", None, None, 3601, None, None, None, None)
    got = _health(
        spark, [well, ill, dead],
        [("well", "phone", True, 10**7), ("well", "pad", False, 86400), ("well", "odd", None, None), ("ill", "pc", False, None), ("ill", "mac", False, 86401)],
        [("ill", "b.md"), ("ill", "a.md")], [("well", 45 * 86400), ("ill", 90 * 86400), ("ill", 45 * 86400 + 1)],
        [("ill", "record_type", "x", 2), ("ill", "record_type", "y", 3), ("ill", "entrypoint", "z", 1), ("ill", "malformed", "lines", 9)],
    )
    assert got == {
        ("ill", "heartbeat_old", None, 601, None), ("ill", "reconcile_old", None, 3601, None), ("ill", "sync_unreachable", None, None, None),
        ("ill", "disk_low", None, None, 29), ("ill", "embedding_backlog", None, 86401, 7), ("ill", "device_never_seen", "pc", None, None),
        ("ill", "device_gone", "mac", 86401, None), ("ill", "conflict_files", "a.md", None, 2), ("ill", "export_old", None, 45 * 86400 + 1, None),
        ("ill", "format_drift", "record_type", None, 5), ("ill", "format_drift", "entrypoint", None, 1),
        ("dead", "heartbeat_missing", None, None, None), ("dead", "never_reconciled", None, 3601, None),
    }


def test_a_moved_key_moves_everywhere(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "key string, project_id long")
    changes = spark.createDataFrame([("c", 1), ("a", 3), ("new", 9), ("d", 3)], "key string, project_id long")
    after, moves, emptied = cascades.reassigned(keys, changes)
    assert set(map(tuple, after.collect())) == {("a", 3), ("b", 1), ("c", 1), ("d", 3), ("new", 9)}
    assert set(map(tuple, moves.collect())) == {("a", 1, 3), ("c", 2, 1)}
    assert set(map(tuple, emptied.collect())) == {(2, 1)}
    memories = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2), (4, "lost", 2), (5, None, 3)], "id int, project_key string, project_id long")
    assert set(map(tuple, cascades.moved_rows(memories, moves, emptied).collect())) == {(1, "a", 3), (2, "b", 1), (3, "c", 1), (4, "lost", 1), (5, None, 3)}
    chunks = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, 2, True)], "id int, project_id long, pending boolean")
    assert set(map(tuple, cascades.moved_projects(chunks, emptied, "pending").collect())) == {(1, 1, True), (2, 1, False), (3, 1, True)}
    projects = spark.createDataFrame([(1, "auto"), (2, "auto"), (3, "config")], "project_id long, created_by string")
    assert {r[0] for r in cascades.remaining(projects, emptied).collect()} == {1, 3}
    kept = cascades.remaining(projects.withColumn("created_by", F.lit("config")), emptied)
    assert kept.count() == 3


def test_flags_and_titles_follow_their_sessions(spark):
    docs = spark.createDataFrame([("message", "s1", "hi", False), ("session", "s1", "old", False), ("session", "s2", "kept", True), ("note", None, "n", True)],
                                 "doc_type string, session string, text string, automated boolean")
    sessions = spark.createDataFrame([("s1", "automated", "new"), ("s2", "interactive", ""), ("s3", "x", "first")], "session string, kind string, title string")
    assert {(r["text"], r["automated"]) for r in cascades.flagged(docs, sessions).collect()} == {("hi", True), ("old", True), ("kept", False), ("n", True)}
    assert {r["text"] for r in cascades.titled(docs, sessions).collect()} == {"hi", "new", "kept", "n", "first"}


def test_a_failing_step_stops_no_other(spark):
    rows = maintenance.run_all(spark, [("prune", lambda: 3), ("merge", lambda: 1 // 0), ("read", lambda: spark.read.parquet("/none").count()), ("optimize", lambda: None)])
    got = [(r["step"], r["ok"], (r["detail"] or "").split(":")[0]) for r in rows.orderBy("at").collect()]
    assert got == [("prune", True, "3"), ("merge", False, "ZeroDivisionError"), ("read", False, "AnalysisException"), ("optimize", True, "")]


def test_stale_lines_stay_away(spark):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "key string")
    got = maintenance.without_stale(rows("ours", "live", "gone", "live"), rows("ours"), rows("live", "other"), "key")
    assert sorted(r[0] for r in got.collect()) == ["live", "live", "ours"]


def test_names_are_unique(spark):
    bases = ["x", "x", "x", "x-2", "x-2", "x-3", "x-2-2", "y", "x", "x-02", "y-1"]
    rows = spark.createDataFrame(list(enumerate(bases)), "i int, base string")
    got = {r["i"]: r["name"] for r in activity.named(rows, "base", "i").collect()}
    assert len(set(got.values())) == len(bases)
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 8)] == ["x", "x-4", "x-5", "x-2", "x-2-3", "x-3", "x-2-2", "x-6"]


def test_aliases(spark):
    rows = [
        ("-home-me-src-App", None, "src-app"), ("-home-me", None, "home"), ("-Users-x-Big--Thing", "/a/b", "big-thing"), ("-mnt-c-work-thing", "C:\\work\\My Thing", "work-my-thing"),
        ("-mnt-c-work-thing", None, "work-thing"), ("-home-me-app--claude-worktrees-fix-1", None, "app"), ("---", None, "project"), ("-x", "///", "x"),
    ]
    df = spark.createDataFrame(rows, "key string, cwd string, want string")
    assert [r[0] for r in df.select(activity.alias(F.col("key"), F.col("cwd"))).collect()] == [w for *_, w in rows]


def test_backfill_goes_on_where_it_was_stopped(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    rows = [(f"c{k}", datetime(2024, 1, 1) + timedelta(days=k) if k % 9 else None, f"text {k}") for k in range(50)]
    chunks = lambda: spark.createDataFrame(rows, "chunk_id string, ts timestamp, text string")
    embed = lambda df: chunking.embedded(df, "text", 8)
    assert not backfill.ready(spark, path, "m1")
    assert backfill.run(spark, path, chunks, embed, "m1", batch=12, most=2) == 2
    first = {r["chunk_id"] for r in backfill.nearest(spark, path, "m1").collect()}
    rest = {r[0] for r in rows} - first
    newest = {c: ts or datetime(1900, 1, 1) for c, ts, _ in rows}
    assert 10 <= len(first) <= 40 and min(newest[c] for c in first) >= max(newest[c] for c in rest)

    def breaks(df):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        backfill.run(spark, path, chunks, breaks, "m1", batch=12)
    assert {r["chunk_id"] for r in backfill.nearest(spark, path, "m1").collect()} == first
    calls = []

    def meanwhile(df):
        if not calls:
            rows[0] = (*rows[0][:2], "rewritten")
            rows.pop(1)
        calls.append(1)
        return embed(df)

    backfill.run(spark, path, chunks, meanwhile, "m1", batch=1000)
    held = [r["chunk_id"] for r in backfill.nearest(spark, path, "m1").collect()]
    assert len(held) == len(set(held)) and {r[0] for r in rows} - set(held) <= {"c0"}
    backfill.run(spark, path, chunks, embed, "m1")
    assert backfill.pending(spark, path, chunks(), "m1").count() == 0 and backfill.run(spark, path, chunks, embed, "m1") == 0
    assert backfill.pending(spark, path, chunks(), "m2").count() == len(rows) and backfill.ready(spark, path, "m1") and not backfill.ready(spark, path, "m2")
    assert sinks.next_batch(spark, path) >= 4


def test_a_release_is_seen_whole(spark, tmp_path):
    path = f"{tmp_path}/r"
    for number in (1, 2):
        storage.release(path, number, {"a": spark.range(number), "b": spark.range(10 * number)})
    spark.range(99).write.parquet(f"{path}/release=3/a")  # a release that never was finished
    assert (storage.released(spark, path, "a").count(), storage.released(spark, path, "b").count()) == (2, 20)


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_lines_of_any_split(spark, tmp_path, split):
    texts = {"a/x.jsonl": b'{"k": 1}\n\n{"k": "' + "é漢".encode() * 40 + b'"}\r\n' + b"bad \xff byte\n" + b"unfinished", "b y.jsonl": b"one\ntwo\n", "c.jsonl": b"", "d.txt": b"no\n"}
    for name, content in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = transcripts.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = set()
    for name, content in texts.items():
        at = 0
        for piece in content.split(b"\n")[:-1] if name.endswith(".jsonl") else ():
            want.add((name.split("/")[-1].replace(" ", "%20"), at, piece.decode("utf-8", "replace")))
            at += len(piece) + 1
    assert {(r["path"].split("/")[-1], r["offset"], r["line"]) for r in found} == want and len(found) == len(want)
    for r in found:
        assert transcripts.line_at(spark, r["path"], r["offset"]) == r["line"].rstrip("\r")


def test_rate_limits_keep_large_ids_and_null_keys(spark):
    rows = [(2**60 + 1, None, NOW)] * 5 + [(2**60 + 3, "u", NOW + timedelta(seconds=k)) for k in range(4)] + [(None, "u", None)]
    calls = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    got = surface.admitted(calls, "user", "ts", "event_id", rate=3, seconds=60).collect()
    assert {r["event_id"] for r in got} == {2**60 + 1, 2**60 + 3, None}
    assert sum(r["admitted"] for r in got if r["user"] is None) == 3 and sum(r["admitted"] for r in got if r["user"] == "u" and r["ts"]) == 3


def test_filtered_neighbours_equal_filter_first(spark):
    vectors = spark.createDataFrame([(k, [float(k % 97), float(k % 89), 1.0]) for k in range(800)], "vec_id long, embedding array<float>")
    query = vectors.filter("vec_id = 3")
    for rule in ("vec_id % 2 = 0", "vec_id % 131 = 7", "vec_id > 795", "vec_id < 0"):
        allowed = vectors.filter(rule).select("vec_id")
        got = retrieval.filtered_nearest(vectors, query, allowed, "vec_id", k=10, first=10, most=160).collect()
        want = retrieval.top(retrieval.cosine(vectors.filter(rule), query).select("vec_id", "score"), "vec_id", 10).collect()
        assert got == want


def test_redaction_takes_as_long_as_the_text(spark):
    secret = 'password = "h4rdToGuess!{}"\n'
    times = []
    for n in (4_000, 16_000):
        text = "".join(secret.format(k) for k in range(n))
        began = time.process_time()
        done = redaction.redact_text(text)
        times.append(time.process_time() - began)
        assert done.count("[REDACTED:password]") == n and "h4rd" not in done
    assert times[1] < 10 * times[0] + 0.5


@pytest.mark.parametrize(
    "text,shown,typed",
    [
        ("<command-name>/x</command-name><command-args>a <system-reminder>s</system-reminder></command-args>", "/x a", True),
        ("<bash-input>ls <system-reminder>s\nt</system-reminder></bash-input>", "! ls", True),
        ("<system-reminder>a <command-args>b</command-args></system-reminder>", "", False),
        ("<bash-stdout>out <system-reminder>s</system-reminder></bash-stdout>", "out", False),
        ("<command-args>q <bash-stdout>o</bash-stdout></command-args><command-name>y</command-name>", "/y q o", True),
        ("plain <b>text</b>", "plain <b>text</b>", True),
    ],
)
def test_injected_text_goes_wherever_it_stands(text, shown, typed):
    assert transcripts.clean_prompt(text) == (shown, typed)


def test_tail_goes_on_after_a_restart(tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"old1\nold2\n")

    def told(reader, start, end):
        return [(r[2], r[3]) for p in reader.partitions(start, end) for r in reader.read(p)]

    first = tail.TailReader(str(log))
    begun = first.latestOffset()
    assert told(first, {}, begun) == [(0, "old1"), (0, "old2")]
    log.write_bytes(b"new1\nnew2\n")  # rewritten while nobody looked
    again = tail.TailReader(str(log))
    then = again.latestOffset()
    assert [line for _, line in told(again, begun, then)] == ["new1", "new2"]
    with log.open("ab") as f:
        f.write(b"new3\n")
    end = again.latestOffset()
    assert [line for _, line in told(again, then, end)] == ["new3"]
    third = tail.TailReader(str(log))
    assert told(third, end, third.latestOffset()) == []


def test_tail_reads_files_with_long_first_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "READ_BYTES", 100)
    (tmp_path / "a.jsonl").write_bytes(b"x" * 1000 + b"\nshort\n")
    reader = tail.TailReader(str(tmp_path / "*.jsonl"))
    rows = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    assert [len(r[3]) for r in rows] == [1000, 5]
    assert re.fullmatch("x+", rows[0][3])
