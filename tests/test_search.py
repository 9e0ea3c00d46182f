"""The stored text index against a plain search."""

import re
from collections import Counter

import numpy as np
import pytest

from atlas_spark.operators import search as S
from atlas_spark.session import shared_folder


def plain(docs, queries, top):
    out = set()
    tokens = {i: Counter(w for w in re.split(r"[\W_]+", (t or "").lower()) if w) for i, t in docs}
    for q in set(queries):
        words = {w for w in re.split(r"[\W_]+", (q or "").lower()) if w}
        hits = [(-sum(c[w] for w in words) / c.total(), i) for i, c in tokens.items() if words and all(w in c for w in words)]
        out |= {(q, i, round(-r, 9)) for r, i in sorted(hits)[:top]}
    return out


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    words = ["the", "of"] + [f"w{i}" for i in range(30)]
    share = np.array([0.3, 0.15] + [0.55 / 30] * 30)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=share))) for i in range(400)]
    return rows + [(400, None), (401, ""), (402, "... --"), (403, "Ünder Straße, the THE"), (404, "the " * 5000), (405, "w1 the w2"), (406, "w1 the w2")]


QUERIES = ["the", "the of", "THE of, w1", "w1 w2", "w1", "absent the", "", None, "straße", "w1 w1", "ünder the"]


@pytest.mark.parametrize("block,top", [(10_000, 100), (16, 5), (7, 50), (16, 1000)])
def test_search(spark, docs, block, top):
    """Blocks of any size and lists of any length give the same answers; the query reads the index and no text."""
    df = spark.createDataFrame(docs, "doc_id bigint, body string")
    index = S.build_text_index(df, "doc_id", "body", shared_folder(spark, "text-index"), block=block, parts=4)
    got = S.fulltext_search(spark.createDataFrame([(q,) for q in QUERIES], "query string"), index, top).collect()
    want = plain(docs, [q for q in QUERIES if q is not None], top)
    assert len(got) == len(want) and {(r["query"], r["id"], round(r["relevance"], 9)) for r in got} == want
    if block == 16:
        spread = index.blocks.filter("token = 'the'").agg({"block": "max", "n": "max"}).first()
        assert max(spread) <= 400 and index.blocks.filter("token = 'the'").count() > 10 and index.blocks.filter("n > 16").isEmpty()


def test_empty_index(spark):
    index = S.build_text_index(spark.createDataFrame([], "doc_id bigint, body string"), "doc_id", "body", shared_folder(spark, "text-index"))
    assert S.fulltext_search(spark.createDataFrame([("a",)], "query string"), index).count() == 0


def test_texts_are_read_at_build_time_only(spark, tables, monkeypatch):
    index = S.build_text_index(tables.documents, "doc_id", "text", shared_folder(spark, "text-index"))
    seen = []
    original = S.cut_lineage

    def spy(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return original(df)
    monkeypatch.setattr(S, "cut_lineage", spy)
    found = S.fulltext_search(spark.createDataFrame([("the of",)], "query string"), index)
    seen.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() and len(seen) > 2 and not any("text#" in p for p in seen)


def test_words_are_counted_in_their_row(spark, docs):
    """No shuffle before the postings are dealt; repeated ids are still counted together, hot words ranked in pieces give the same index."""
    df = spark.createDataFrame(docs, "doc_id bigint, body string")
    assert "Exchange" not in S.token_table(df, "doc_id", "body")._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(1, "b a b"), (1, "b a c"), (1, "a"), (None, "x y"), (None, "x x"), (2, None), (3, "")], "doc_id bigint, body string")
    got = {(r["id"], r["n_tokens"], r["token"]): r["tf"] for r in S.token_table(twice, "doc_id", "body").collect()}
    assert got == {(1, 3, "a"): 2, (1, 3, "b"): 3, (1, 3, "c"): 1, (1, 1, "a"): 1, (None, 2, "x"): 3, (None, 2, "y"): 1}
    rows = []
    for hot in (10, 100_000):
        index = S.build_text_index(df, "doc_id", "body", shared_folder(spark, "text-index"), block=16, parts=4, hot_rows=hot)
        rows.append(sorted(tuple(r) for r in index.postings.select("token", "block", "id", "n_tokens", "tf", "share", "part").collect()))
    assert rows[0] == rows[1]
