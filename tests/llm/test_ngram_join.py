"""The n-gram join against all pairs, and the pigeonhole on random sets."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from convolake.llm import bloom, ngram_join, words

SCHEMA = "doc_id long, text string, name long, n long, marks string"


def _shingles(text: str | None) -> set[tuple[str, ...]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute(rows: list[tuple]) -> list[tuple]:
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(k)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def _rows() -> list[tuple]:
    rnd = random.Random(7)
    vocabulary = [f"wörd{k}" for k in range(500)] + ["The", "A", "漢字"]
    rows: list[tuple] = []
    for size in [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 24, 30, 40, 60, 100, 150, 400] * 3:
        text = rnd.choices(vocabulary, k=size)
        rows.append((len(rows), " ".join(text)))
        for _ in range(rnd.randrange(0, 6)):  # chains of copies, each with some words changed, added or cut
            text = list(text)
            for _ in range(rnd.choice([0, 1, 1, max(1, size // 40), max(1, size // 25)])):
                kind, at = rnd.randrange(3), rnd.randrange(len(text))
                text[at : at + (kind < 2)] = [] if kind == 1 and len(text) > 1 else [rnd.choice(vocabulary)]
            rows.append((len(rows), rnd.choice([" ", "\n", " \t"]).join(x.upper() if rnd.random() < 0.1 and x.isascii() else x for x in text)))
    shared = " ".join(rnd.choices(vocabulary, k=40))  # a passage that many documents share
    for _ in range(30):
        rows.append((len(rows), shared + " " + " ".join(rnd.choices(vocabulary, k=rnd.choice([6, 9, 12, 15])))))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a a a a a a a"), (1006, "a " * 50_000)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "nobody else has this text at all"), (5, rows[40][1]), (2**60 + 1, rows[20][1])]
    return rows


def _run(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=repr)


def test_op11_equals_all_pairs(spark, tmp_path):
    rows = _rows()
    want = sorted(_brute(rows), key=repr)
    assert len({c for *_, c in want}) < 0.8 * len(want)
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = ngram_join.op11_ngram_join(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_op11_with_small_blocks_and_runs(spark, monkeypatch):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(90)]
    base = rnd.choices(vocabulary, k=60)
    rows = []
    for i in range(70):  # one family around the threshold: pivots alone don't link it
        text = list(base)
        for _ in range(rnd.randrange(0, 5)):
            text[rnd.randrange(60)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 16)
    assert _run(spark, rows) == sorted(_brute(rows), key=repr)


def test_op11_of_no_rows(spark):
    assert _run(spark, [], 1) == []


def test_alike_sets_always_meet():
    rnd = np.random.default_rng(3)
    often = np.zeros(ngram_join.SLOTS, np.uint16)
    met = 0
    for _ in range(1500):
        size = int(rnd.integers(1, 120))
        pool = np.unique(words.mixed(rnd.integers(0, 1 << 60, size + 40, dtype=np.uint64)))
        a = pool[:size]
        gone = rnd.permutation(size)[: rnd.integers(0, 2 + size // 8)]
        b = np.sort(np.concatenate([np.delete(a, gone), pool[size : size + int(rnd.integers(0, 2 + size // 8))]]))
        if not ngram_join.alike(a, b):
            continue
        met += 1
        small, large = sorted((a, b), key=len)
        level = ngram_join.band(len(small))
        assert level in ngram_join.levels(len(large))
        often[a[: size // 3] & np.uint64(ngram_join.SLOTS - 1)] = 9  # frequent shingles change what is asked for
        asked, wanted, *_ = ngram_join.signatures(large, level, often, 5.0)
        own, _, listed, rare = ngram_join.signatures(small, level, often, 5.0)
        assert np.intersect1d(asked, np.concatenate([own, listed, rare])).size
        assert not np.intersect1d(own, np.concatenate([listed, rare])).size
        assert not np.intersect1d(asked[~wanted], rare).size
        assert ngram_join.may_be_alike(ngram_join.marks(a), ngram_join.marks(b), len(a), len(b))
    assert met > 300


def test_runs_tell_every_member_of_an_asked_key(monkeypatch):
    asks = -(1 << 63)
    rows = [(1, 5), (2, asks + 3), (2, asks + 7), (2, 4), (4, 1), (4, 2), (9, asks + 1), (9, 8)]
    rows += [(12, asks + k) for k in range(40)] + [(13, k) for k in range(40)] + [(14, asks + 50), (14, 51)]

    def told(size):
        batches = [rows[k : k + size] for k in range(0, len(rows), size)]
        arrow = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*b, strict=True)], names=["key", "rank"]) for b in batches]
        found = [r for b in ngram_join._runs(iter(arrow)) for r in b.to_pylist()]
        return {(r["name"], r["pivot"]) for r in found}

    want = {(3, 3), (7, 3), (4, 3), (1, 1), (8, 1), *((k, 0) for k in range(40)), (50, 50), (51, 50)}
    assert told(100) == want
    monkeypatch.setattr(ngram_join, "HELD", 10)
    for size in (1, 3, 11, 100):
        assert told(size) == want


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_bloom_loses_nothing(spark, n):
    values = words.mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)).view(np.int64).tolist()
    held = bloom.held(spark.createDataFrame([(v,) for v in values] + [(None,)], "x long"), "x")
    assert bloom.may_hold(held, np.array(values, np.int64)).all()
    other = words.mixed(np.arange(10_000, dtype=np.uint64))
    assert bloom.may_hold(held, other).mean() < 0.1


def test_words_of_odd_texts():
    texts = [b"", b"Ab cD", b"  ", b"x" * 3_000_000 + b" ab", "é　ü ab".encode(), b"ab\x00c\x1cd"]
    w = words.found(texts, words.flags(b" \t\n\x0b\f\r"))
    got = [(int(d), bytes(w.data[s:e])) for d, s, e in zip(w.doc, w.starts, w.ends, strict=True)]
    assert got == [(k, x) for k, t in enumerate(texts) for x in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
    by_word = defaultdict(set)
    for (_, x), h in zip(got, w.hashes.tolist(), strict=True):
        by_word[x].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    column = pa.array([None if t == b"" else t.decode() for t in texts])
    assert [(k, len(s)) for k, s in words.slices(column)] == [(0, 3), (3, 1), (4, 2)]
    assert [t for _, s in words.slices(column) for t in s] == texts
    assert list(words.slices(column.slice(0, 0))) == []
