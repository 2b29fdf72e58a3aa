"""Memory saves and archiving against the versions that requests name."""

from __future__ import annotations

import hashlib

from convolake.operators import memories as Y

MEMORY = "project string, name string, title string, description string, type string, body string, sha256 string"
REQUEST = "seq long, project string, name string, mode string, expected string, title string, description string, type string, body string"


def _sha(*fields):
    return hashlib.sha256("\x1f".join(fields).encode()).hexdigest()


def _memory(name, body="old body\n", title="Old"):
    fields = (title, "about", "user", body)
    return ("p", name, *fields, _sha(*fields))


def test_saves_change_only_what_they_have_read(spark):
    a, b, c = _memory("a"), _memory("b"), _memory("c", title="")
    rows = [
        (1, "p", "a", "replace", a[-1], " New \n title", "d", "project", "new body"),
        (2, "p", "a", "append", a[-1], "", "", "", "late"),  # a has changed by now
        (3, "p", "b", "append", b[-1], "", "more", "", "\nadded\n"),
        (4, "p", "c", "replace", "other version", "t", "d", "user", "x"),
        (5, "p", "new", "create", None, "t", "d", "user", "x"),
        (6, "p", "new", "create", None, "t", "d", "user", "y"),
        (7, "p", "a", "create", None, "t", "d", "user", "x"),
        (8, "p", "none", "append", None, "", "", "", "x"),
        (9, "p", "UPPER/case", "create", None, "t", "d", "user", "x"),
        (10, "p", "b", "replace", None, "t", "d", "user", "x"),
        (11, "p", "bad1", "create", None, "", "d", "user", "x"),
        (12, "p", "bad2", "create", None, "t", "d", "poem", "x"),
        (13, "p", "bad3", "create", None, "t", "d", "user", " \n "),
        (17, "p", "bad5", "create", None, "t", "d", "user", "é" * 10_001),
        (14, "p", "bad4", "rewrite", None, "t", "d", "user", "x"),
        (15, "q", "a", "create", None, "t", "d", "user", "other project"),
        (16, None, None, None, None, None, None, None, None),
    ]
    after, told = Y.saved(spark.createDataFrame([a, b, c], MEMORY), spark.createDataFrame(rows, REQUEST))
    assert dict(map(tuple, told.collect())) == {
        1: "done", 2: "changed", 3: "done", 4: "changed", 5: "done", 6: "exists", 7: "exists", 8: "missing", 9: "invalid", 10: "changed",
        11: "invalid", 12: "invalid", 13: "invalid", 14: "invalid", 15: "done", 16: "invalid", 17: "invalid",
    }
    got = {(r["project"], r["name"]): tuple(r)[2:] for r in after.collect()}
    want = {
        ("p", "a"): ("New title", "d", "project", "new body"), ("p", "b"): ("Old", "more", "user", "old body\n\nadded"),
        ("p", "c"): c[2:6], ("p", "new"): ("t", "d", "user", "x"), ("q", "a"): ("t", "d", "user", "other project"),
    }
    assert {k: v[:4] for k, v in got.items()} == want
    assert all(v[4] == _sha(*v[:4]) for v in got.values())
    again, told = Y.saved(after, spark.createDataFrame(rows[:2], REQUEST))
    assert {r["outcome"] for r in told.collect()} == {"changed"} and sorted(again.collect()) == sorted(after.collect())


def test_archived_memories_leave_with_their_line(spark):
    a, b = _memory("a"), _memory("b")
    asked = [(1, "p", "a", a[-1], " no longer so ", "2026"), (2, "p", "a", a[-1], "again", "2026"), (3, "p", "b", "stale", "why", "2026"),
             (4, "p", "b", b[-1], " ", "2026"), (5, "p", "none", None, "why", "2026")]
    index = spark.createDataFrame([("p", "a.md", "A"), ("p", "b.md", "B"), ("q", "a.md", "other")], "project string, target string, title string")
    requests = spark.createDataFrame(asked, "seq long, project string, name string, expected string, reason string, at string")
    after, gone, lines, told = Y.archived(spark.createDataFrame([a, b], MEMORY), requests, index)
    assert dict(map(tuple, told.collect())) == {1: "done", 2: "missing", 3: "changed", 4: "invalid", 5: "missing"}
    assert [r["name"] for r in after.collect()] == ["b"] and {r["title"] for r in lines.collect()} == {"B", "other"}
    assert [(r["name"], r["body"], r["reason"]) for r in gone.collect()] == [("a", "old body\n", "no longer so")]


def test_titles_come_from_the_index_first(spark):
    rows = spark.createDataFrame([_memory("a"), _memory("b"), _memory("c", title="")], MEMORY)
    index = spark.createDataFrame([("p", "a.md", "Line"), ("p", "c.md", "")], "project string, target string, title string")
    assert {r["name"]: r["title"] for r in Y.with_titles(rows, index).collect()} == {"a": "Line", "b": "Old", "c": "c"}


def test_counters_add_up(spark):
    held = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "category string, value string, n long")
    seen = spark.createDataFrame([("a", "x", 3), ("c", "z", 1)], "category string, value string, n long")
    assert set(map(tuple, Y.counted(held, seen, "category", "value").collect())) == {("a", "x", 5), ("b", "y", 1), ("c", "z", 1)}
