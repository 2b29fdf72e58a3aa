"""Sidecars, saved outputs, details, kinds and versions."""

from __future__ import annotations

import json

import pytest

from convolake.sources import sidefiles


def _write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_subagents_have_their_sidecars(spark, tmp_path):
    _write(tmp_path, "p/s/subagents/agent-1.meta.json", json.dumps({"agentType": "Explore", "description": "looks\naround", "more": [1]}))
    _write(tmp_path, "p/s/subagents/agent-2.meta.json", "{broken")
    _write(tmp_path, "p/s/subagents/agent-3.meta.json", "[1, 2]")
    _write(tmp_path, "p/s/subagents/agent-4.meta.json", json.dumps({"agentType": "", "description": None}))
    _write(tmp_path, "p/s/subagents/agent-1.jsonl", "{}\n")
    found = sidefiles.subagents(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: (r["agent_type"], r["description"]) for r in found.collect()}
    assert got == {"agent-1.jsonl": ("Explore", "looks\naround"), "agent-2.jsonl": (None, None), "agent-3.jsonl": (None, None), "agent-4.jsonl": (None, None)}
    path = next(r["path"] for r in found.collect() if r["agent_type"])
    sessions = spark.createDataFrame([(path, "s1"), ("elsewhere", "s2")], "path string, session string")
    assert {(r["session"], r["agent_type"]) for r in sidefiles.with_subagents(sessions, found).collect()} == {("s1", "Explore"), ("s2", None)}


def test_saved_outputs_are_found_in_order(spark, tmp_path):
    _write(tmp_path, "p/s/tool-results/toolu_1.txt", "whole one\nsecret = ghp_" + "a1" * 20)
    _write(tmp_path, "p/s/tool-results/toolu_1.json", "{}")
    _write(tmp_path, "p/s/tool-results/toolu_2.json", '{"two": 2}')
    _write(tmp_path, "p/s/tool-results/other-3.txt", "named in the text")
    _write(tmp_path, "p/t/tool-results/toolu_5.txt", "another session's")
    saved = sidefiles.outputs(spark, str(tmp_path))
    base = next(r["base"] for r in saved.collect() if r["name"] == "toolu_2.json")
    rows = [
        (1, f"{base}.jsonl", "toolu_1", "cut"), (2, f"{base}/subagents/agent-1.jsonl", "toolu_2", None),
        (3, f"{base}.jsonl", "toolu_3", "saved to x/tool-results/none.txt and x/tool-results/other-3.txt"),
        (4, f"{base}.jsonl", "toolu_4", "nothing"), (5, f"{base}.jsonl", "toolu_5", "x"), (6, f"{base}.jsonl", None, "tool-results/other-3.txt"),
        (7, f"{base}.jsonl", "../evil", "tool-results/other-3.txt"),
    ]
    results = spark.createDataFrame(rows, "message_id long, path string, tool_use_id string, text string")
    got = {r["message_id"]: (r["full_text"], r["origin"]) for r in sidefiles.full_texts(results, saved).collect()}
    assert got.pop(1)[0].startswith("whole one\nsecret = [REDACTED:")
    assert got == {
        2: ('{"two": 2}', "tool-results file toolu_2.json"), 3: ("named in the text", "tool-results file other-3.txt"),
        4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None),
    }


def test_details_and_kinds(spark):
    roles = spark.createDataFrame([(r,) for r in ("user", "assistant", "summary", "tool_call", "tool_result", "other")], "role string")
    assert [sidefiles.detailed(roles, d).count() for d in ("conversation", "tools", "full")] == [2, 5, 5]
    with pytest.raises(ValueError):
        sidefiles.detailed(roles, "all")
    sessions = spark.createDataFrame([(1, "cli"), (2, "sdk"), (3, "new"), (4, "new"), (5, None), (6, "")], "id int, entrypoint string")
    kinds, drift = sidefiles.session_kinds(sessions, ["sdk"], ["cli"])
    assert {r["id"] for r in kinds.filter("kind = 'automated'").collect()} == {2} and kinds.count() == 6
    assert list(map(tuple, drift.collect())) == [("entrypoint", "new", 2)]


def test_newest_versions(spark):
    paths = ["a/x~20240101-000000.md", "a/x~20240102-000000.md", "a/x.md", "b~c~20240101-000000", "a/x~2024.md", "x~20240101-000000.tar.gz"]
    got = sidefiles.versions(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {tuple(r) for r in got} == {("a/x.md", "20240102-000000", paths[1]), ("b~c", "20240101-000000", paths[3])}
