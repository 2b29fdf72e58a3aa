"""The keyword index: terms, scores and plans against SQLite's full-text search."""

from __future__ import annotations

import random
import sqlite3

import duckdb
import pytest

from convolake.functions import stem
from convolake.operators import index
from convolake.plans import retrieval as plans

TOKENIZER = "porter unicode61 remove_diacritics 2"
SUFFIXES = """ational tional enci anci izer logi bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti
    biliti icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize s es ies
    sses ss ed eed ing y e ll tion sion""".split()
QUERIES = (
    "alpha OR beta", "running alphas", "naïve OR résumés", "cat NOT dogs", '"dogs running"', '"the dog run"', "licens*", "(bird OR cat) NOT dog",
    "relational condition", "alpha beta OR (gamma NOT delta)", '"cat cat"', "zebra", "run* NOT cat", "cat OR cat",
)


def _fts(rows) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE d USING fts5(text, tokenize='{TOKENIZER}')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", rows)
    return con


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = "alpha alphas beta gamma delta eps cat cats dog dogs run running runs the bird licensed licensing relational relate conditions".split()
    words += ["Naïve", "naive", "RÉSUMÉ", "résumés", "漢字", "straße", "cat-dog", "résumé"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 30))) for _ in range(150)]
    return [*enumerate(texts, 1), (900, None), (901, ""), (2**60 + 1, "alpha cat dogs"), (2**60 + 3, "the dog runs naïvely")]


@pytest.fixture(scope="module")
def searched(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{path}/i")
    return index.Index(spark, f"{path}/i")


def test_terms_equal_fts5():
    rnd = random.Random(4)
    words = {"".join(rnd.choices("aeiouybcdlstrnzwxé", k=rnd.randrange(6))) + "".join(rnd.choices(SUFFIXES, k=rnd.randrange(3))) for _ in range(6000)}
    words = sorted({*words, "a", "is", "yes", "y", "été", "ångströms", "x" * 70 + "ing", "generalizations", "skies", "ties"} - {""})
    con = _fts(list(enumerate(words)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, 'instance')")
    want = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert [stem.term(w) for w in words] == [want[i] for i in range(len(words))]


@pytest.mark.parametrize("query", QUERIES)
def test_scores_equal_fts5(searched, rows, query):
    want = dict(_fts(rows).execute("SELECT rowid, -bm25(d) FROM d WHERE d MATCH ?", (query,)).fetchall())
    got = {r["doc_id"]: r["score"] for r in searched.search(query).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("query,like", [("cat (dog", "cat dog"), ('"dogs running', "dog run"), ("cat) dog", "cat dog"), ("naïve-cat*", "naive")])
def test_queries_that_cant_be_read_are_plain_words(searched, query, like):
    got, want = ({r["doc_id"] for r in searched.search(q).collect()} for q in (query, like))
    assert got <= want if "-" in query else got == want


def test_queries_without_words_fail(searched):
    with pytest.raises(ValueError):
        searched.search('"--"')


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_filtered_topk", "bm25_prefix", "bm25_boolean", "fts_phrase", "fts_fallback"])
def test_searches_never_read_texts(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not [line for line in scans if "text" in line.split("Batched")[0]]
    if name in ("bm25_topk", "fts_phrase"):
        assert all("PartitionFilters: []" not in line for line in scans if "positions" in line)


def test_an_empty_index(spark, tmp_path):
    index.build(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/i")
    assert index.Index(spark, f"{tmp_path}/i").search("cat OR dog").collect() == []


def test_listed_forms_alone_count(spark, tmp_path):
    rows = [(1, "under it"), (2, "Underer it"), (3, "unders under it"), (4, "ündering it"), (5, "underous")]
    index.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/i")
    held = index.Index(spark, f"{tmp_path}/i")
    found = lambda query, forms=None: {r["doc_id"] for r in held.search(query, forms).collect()}
    assert found("under") == {1, 2, 3, 4, 5}
    assert found("under", {"under": ("under", "unders", "undering")}) == {1, 3, 4}
    assert found('"under it"', {"under": ("unders", "undering")}) == {4}
    assert found('"under under"') == {3}


@pytest.mark.parametrize("name", ["hit_keys", "hybrid_search_capped", "hit_rows"])
def test_rare_words_of_a_stem_dont_part_searches_from_their_sql(spark, tmp_path, name):
    rows = [(c, t, ("user", "assistant")[t % 2], f"the word {c} and more {'x ' * (c % 5 + t)}") for c in range(30) for t in range(4)]
    rows += [(40, 0, "user", "underer the"), (41, 0, "user", "underous"), (42, 0, "user", "andes and theing"), (43, 0, "user", "and unde")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_only_blocks_of_postings_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"cat word{i % 3} Cät cats") for i in range(50)], "doc_id long, text string").coalesce(1)
    found = index.postings(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") <= 1  # that of coalesce(1), if any
    rows = {r["form"]: r for r in found.collect()}
    assert set(rows) == {"cat", "cats", "word0", "word1", "word2"}
    assert rows["cats"]["term"] == "cat" and rows["cats"]["docs"] == [*range(50)] and rows["cat"]["positions"] == [[0, 2]] * 50
