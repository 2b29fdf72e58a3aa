"""Ranked retrieval: a small query language, cosine search, fusion, recency, caps and snippets.

Keyword queries are read here and searched by ``operators.index``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.text import tokens

K1, B = 1.2, 0.75
MIN_IDF = 1e-6
CANDIDATES = 50
MAX_KNN = 4096
RRF_K = 60
MAX_PER_SESSION = 3
HALF_LIFE_DAYS = 90.0


@dataclass(frozen=True)
class Phrase:
    """Tokens that stand side by side; the last one may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


Node = tuple  # ("phrase", Phrase) | ("and" | "or" | "not", left, right)


def parse(query: str) -> Node:
    """AND (also by juxtaposition), OR, NOT, "phrases", prefix* and parentheses; OR binds least, NOT most.

    A query that can't be read is searched again as plain tokens.  Raises
    ValueError if it holds no token at all.
    """
    try:
        return _parse(query)
    except (SyntaxError, IndexError):
        plain = [Phrase(tuple(w)) for part in query.split() if (w := re.findall(r"[^\W_]+", part.lower()))]
        if not plain:
            raise ValueError("the query holds no word") from None
        return reduce(lambda a, b: ("and", a, b), [("phrase", p) for p in plain])


def _parse(query: str) -> Node:
    parts = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)
    if query.count('"') % 2:
        raise SyntaxError("open quote")
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def take() -> str:
        nonlocal at
        at += 1
        return parts[at - 1]

    def level(ops: tuple[str, ...], below: Callable[[], Node], implicit: bool) -> Node:
        left = below()
        while (nxt := peek()) is not None and nxt != ")":
            if nxt in ops:
                take()
                left = (nxt.lower(), left, below())
            elif implicit and nxt not in ("OR", "AND", "NOT"):
                left = ("and", left, below())
            else:
                break
        return left

    def leaf() -> Node:
        part = take()
        if part == "(":
            inner = any_of()
            if take() != ")":
                raise SyntaxError("open parenthesis")
            return inner
        if part in (")", "AND", "OR", "NOT"):
            raise SyntaxError(part)
        quoted = part.startswith('"')
        words = re.findall(r"[^\W_]+", part.lower())
        prefix = not quoted and part.endswith("*")
        if not words or not quoted and re.search(r"[^\w*]", part):
            raise SyntaxError(part)
        return ("phrase", Phrase(tuple(words), prefix))

    def without() -> Node:
        return level(("NOT",), leaf, False)

    def all_of() -> Node:
        return level(("AND",), without, True)

    def any_of() -> Node:
        return level(("OR",), all_of, False)

    found = any_of()
    if peek() is not None:
        raise SyntaxError(peek())
    return found


def top(scored: DataFrame, key: str, k: int = CANDIDATES, score: str = "score") -> DataFrame:
    """The ``k`` best rows with ``rank``, from 1; ties go to the smaller key."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf) of words as they are spelt, counted on the map side before they are dealt by term."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def cosine(vectors: DataFrame, query: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, the cosine to the one row of ``query``; zero vectors score 0."""

    def dot(a: str, b: str) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    asked = query.select(F.col(embedding).alias("_q")).limit(1)
    both = vectors.crossJoin(F.broadcast(asked))  # one row
    norm = F.sqrt(dot(embedding, embedding)) * F.sqrt(dot("_q", "_q"))
    return both.withColumn("score", F.when(norm > 0, dot(embedding, "_q") / norm).otherwise(0.0)).drop("_q")


def filtered_nearest(
    vectors: DataFrame, query: DataFrame, allowed: DataFrame, key: str, k: int = CANDIDATES, first: int = CANDIDATES, most: int = MAX_KNN
) -> DataFrame:
    """(key, score, rank) of the ``k`` nearest vectors whose key is ``allowed``.

    The filter is of another table, so few candidates are met with it: the
    nearest ``first``, then four times as many, until enough pass.  Each round
    is a bounded top-n.  Where even ``most`` don't do, the filter goes first, so
    that none is lost.
    """
    near = cosine(vectors, query).select(key, "score")
    n = first
    while True:
        best = near.orderBy(F.desc("score"), key).limit(n)
        seen = best.agg(F.count("*").alias("n")).crossJoin(best.join(allowed.select(key), key, "left_semi").agg(F.count("*").alias("fit"))).first()
        if seen["fit"] >= k or seen["n"] < n:
            return top(best.join(allowed.select(key), key, "left_semi"), key, k)
        if n >= most:
            return top(near.join(allowed.select(key), key, "left_semi"), key, k)
        n = min(4 * n, most)


def fused(*rankings: DataFrame, key: str = "key", k: int = RRF_K) -> DataFrame:
    """(key, rrf, matched) of rankings (key, rank, source): the sum of 1 / (k + best rank) over the sources."""
    every = reduce(DataFrame.unionByName, [r.select(key, "rank", "source") for r in rankings])
    best = every.groupBy(key, "source").agg(F.min("rank").alias("rank"))
    return best.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"),
        F.sort_array(F.collect_set("source")).alias("matched"),
        F.min(F.struct("source", "rank")).alias("seen"),
    )


def recency(ts: Column, now: datetime) -> Column:
    """0.8 to 1.0, halving its excess every 90 days; the future counts as now, null as never."""
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400.0
    fresh = 0.2 * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days) / HALF_LIFE_DAYS)
    return F.when(ts.isNull(), 0.8).otherwise(0.8 + fresh)


def capped(ranked: DataFrame, session: str, order: list, cap: int = MAX_PER_SESSION, exempt: Column | None = None) -> DataFrame:
    """At most ``cap`` rows of a session, best first; rows without a session or ``exempt`` are free."""
    free = F.col(session).isNull() if exempt is None else F.col(session).isNull() | exempt
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return ranked.withColumn("_n", n).filter(free | (F.col("_n") <= cap)).drop("_n")


def snippet(text: Column, query: str, context_chars: int = 300) -> Column:
    """At most ``context_chars`` centred on the first query word that begins a word, with ellipses."""
    terms = {t.lower() for t in re.findall(r"\w+", query) if t not in ("AND", "OR", "NOT", "NEAR")}
    words = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    at = F.regexp_instr(text, F.lit(rf"(?iu)\b({words})")) - 1 if terms else F.lit(-1)
    lead = F.greatest(F.lit(0), F.least(F.length(text) - context_chars, at - context_chars // 2))
    start = F.when(at >= 0, lead).otherwise(0)
    body = F.trim(F.substring(text, start + 1, F.lit(context_chars)))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + context_chars < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= context_chars, text).otherwise(cut)
