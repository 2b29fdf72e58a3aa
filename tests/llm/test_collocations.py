"""Collocations against plain counting, and the minimal perfect hash."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from convolake.llm import bloom, collocations, words
from convolake.llm.perfect import PerfectHash

SCHEMA = "doc_id long, text string, lang string, a long, score long, part string, size int"


def _brute(rows: list[tuple], top: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        longer = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= 50 * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _rows() -> list[tuple]:
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)] + ["Été", "漢", "a\x00b", "Wide\x1cword"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(600):
        parts = [x + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for x in rnd.choices(vocabulary, weights, k=rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(["New York City ", "as well as ", "w0 w0 w0 w0 ", "per cent "]))
        rows.append(("".join(parts), rnd.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "en"), (" \t\n", "fr"), ("lone", "fr"), ("x " * 40_000, "en"), ("z" * 100_000 + " tail", "en")]
    return rows + rows[:20]


def _run(spark, rows, **options):
    docs = spark.createDataFrame([(1, t, lang, 1, 2, "x", 3) for t, lang in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


def test_op12_equals_plain_counting(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame([(k, t, lang, 1, 2, "x", 3) for k, (t, lang) in enumerate(rows)], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = collocations.op12_collocations(spark, str(tmp_path))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _brute(rows, 2000)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 200


def test_op12_with_small_flushes_and_a_short_report(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(collocations, "FLUSH", 500)
    monkeypatch.setattr(collocations, "SEEN", 50)
    assert _run(spark, rows, top=7) == _brute(rows, 7)


def test_op12_of_no_rows(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(None, None), ("few words", "en")]) == []


def test_score_is_exact_for_large_counts(spark):
    a, left, right = 10**14 - 3, 10**14 + 7, 10**14 + 9
    df = spark.createDataFrame([(a, left, right), (3, 7, 11), (10, 10, 10)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score("a", "l", "r")).collect()]
    assert got == [10**6 * x * x // (y * z) for x, y, z in ((a, left, right), (3, 7, 11), (10, 10, 10))]


def test_a_shared_key_fails(spark):
    rows = [(2, 5, "a b"), (3, 5, "a b c"), (2, 6, "a b")]
    assert collocations._spelt_once(spark.createDataFrame(rows, "size int, key long, phrase string")).count() == 3
    with pytest.raises(ValueError, match="share a key"):
        collocations._spelt_once(spark.createDataFrame([*rows, (2, 6, "a c")], "size int, key long, phrase string"))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_has_a_slot_for_each_key(n):
    keys = words.mixed(np.arange(n, dtype=np.uint64))
    for held in (PerfectHash.of(keys), PerfectHash.unpack(PerfectHash.of(keys).pack())):
        assert sorted(held.slots(keys).tolist()) == list(range(n))
        assert (held.slots(words.mixed(np.arange(n, 2 * n + 100, dtype=np.uint64))) == -1).all()
    if n:
        with pytest.raises(ValueError, match="repeat"):
            PerfectHash.of(np.concatenate([keys, keys[:1]]))


def test_safe_phrases_keep_all_with_frequent_parts():
    _, grams = collocations._grams([b"a b c. a b", b"a b c"], ["en", "en"])
    assert [int((g > 0).sum()) for g in grams] == [8, 5, 2]
    full = bytes([255] * 8192)
    assert collocations._safe(grams, 3, full).tolist() == [0, 5]
    assert not len(collocations._safe(grams, 2, bytes(8192)))
    assert bloom.may_hold(full, grams[0]).all()
