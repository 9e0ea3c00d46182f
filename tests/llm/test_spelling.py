"""Spelling variants against a brute-force version; tries against all pairs."""

import random
import zlib
from collections import Counter

import pytest
import re

from atlas_spark.llm import spelling as S
from atlas_spark.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, word string, n bigint, form string, near string, key string"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def neighbours(words):
    """Pairs at distance one by taking each code point out or leaving a gap in its place."""
    by_gap, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1:]), []).append(w)
    for ws in by_gap.values():
        for a in ws:
            near[a].update(x for x in ws if x != a)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def plain(docs, min_count=5, ratio=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = neighbours(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_query(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    rows, want = got(QUERIES["op11_spelling_variants"](spark, sf)), plain(docs)
    assert len(rows) == len(want) and set(rows) == want
    assert any(f for _, f, *_ in want)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    base = ["".join(rng.choice("aenrstéß") for _ in range(rng.randint(6, 9))) for _ in range(150)]
    out = set(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aeéxz") + w[i:], w[:i] + rng.choice("aeéxz") + w[i + 1:], w[:i] + w[i + 1:i + 2] + w[i:i + 1] + w[i + 2:]]))
    return {w: rng.randint(5, 400) for w in out if w}


@pytest.mark.parametrize("depth", [1, 3, 6, None])
def test_near_words_at_every_depth(spark, words, depth):
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = [tuple(r) for r in S.near_words(df, depth).collect()]
    want = {(a, b, words[b]) for a in words for b in words if a != b and edits(a, b) == 1}
    assert len(rows) == len(want) and set(rows) == want


def test_blocks_of_a_common_key(spark, words, monkeypatch):
    """A key of more words than a block holds gives the same pairs, each once."""
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(S, "ASKING", 60)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = [tuple(r) for r in S.near_words(df, 1).collect()]
    want = {(a, b, words[b]) for a in words for b in words if a != b and edits(a, b) == 1}
    assert len(rows) == len(want) and set(rows) == want


def test_one_edit():
    rng = random.Random(5)
    for _ in range(20000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in "xy")
        assert S.one_edit(a, b) == (edits(a, b) == 1), (a, b)


def test_edges(spark):
    long = "wordy" * 20000
    docs = [(1, "Colour colour COLOUR colour, Àcolour\ncolour"), (2, None), (3, ""), (None, "colour colour"), (None, None), (5, f"{long} x"), (6, "short cat 123 abcdef1abcdef"),
            (7, "École école ÉCOLE aaaaaa")] + [(8, "colour colours colours")] * 6 + [(i, long) for i in range(20, 25)] + [(30, "colors colors colors colors colors")]
    df = spark.createDataFrame([(i, t, "w", 1, "f", "n", "k") for i, t in docs], SCHEMA)
    rows = got(S.spelling_variants(df))
    assert sorted(rows, key=str) == sorted(plain(docs), key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert S.spelling_variants(none).count() == 0


def test_chain_of_forms(spark):
    n = {"abcdefg": 5, "abcdefgh": 30, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zzzzzz": 7, "zzzzzy": 34, "zzzzzx": 34}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    rows = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in S.roots(S.forms(df)).collect()}
    assert rows["abcdefg"] == ("abcdefgh", "abcdefghijk", 1, 30) and rows["abcdefghijk"] == (None, "abcdefghijk", 1, None)
    assert rows["zzzzzz"] == (None, "zzzzzz", 2, None)
