"""The filter audit against a plain count over every order, with odd rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from convolake.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n long, h long, mask long, part string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _rows() -> list[tuple]:
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["ABCDEF", "Été", "#tag", "a|b", "100%"]
    found = []
    for i in range(80):
        size = rnd.choice([0, 1, 40, 99, 100, 101, 160])
        text = rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words[: rnd.choice([60, 405])], k=size))
        found.append((i, text, rnd.choice(["en", "de", None, ""])))
    found += [(200 + i, found[i][1], found[i][2]) for i in range(0, 60, 3)]  # exact copies, other ids
    found += [found[4], found[4], (4, "another text of the same id", "en"), (None, found[5][1], "en"), (None, None, None), (None, "", None)]
    found += [(300, None, "en"), (301, "", "en"), (302, " \n ", "fr"), (303, "A" * 50_000, "fr"), (304, "x y " * 60_000, "fr")]
    return found


def _brute(rows: list[tuple], labels: list[tuple]) -> dict:
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    least: dict[str, int] = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    judged = []
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and least[text] < d,
        }
        judged.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = defaultdict(lambda: [0] * 7)
    shapley = defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part, fails, is_good, is_toxic in judged:
            for step, letter in enumerate(order, 1):
                row, before = out[part, order, step], fails & set(order[: step - 1])
                row[0] += not before and letter not in fails
                row[1] += letter in fails and not before
                row[2] += letter in fails and bool(before)
                row[3] += fails == {letter}
                row[4] += letter in fails and not before and is_good
                row[5] += letter in fails and not before and is_toxic
                shapley[part, letter] += letter in fails and not before
    for (part, order, step), row in out.items():
        row[6] = shapley[part, order[step - 1]]
    return out


def test_op13_equals_a_plain_count(spark, tmp_path):
    rows = _rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (200, None, 1)]
    docs = [(d, t, lang, 1, 2, 3, "x") for d, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = filter_audit.op13_filter_audit(spark, str(tmp_path)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found}
    want = _brute(rows, labels)
    assert len(found) == len(want) == 600 * len({lang or "" for _, _, lang in rows})
    assert got == dict(want)


@pytest.mark.parametrize("labelled", [True, False])
def test_op13_of_no_rows(spark, labelled):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1)] if labelled else [], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).collect() == []
