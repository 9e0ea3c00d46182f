"""License scans against plain searches; fuzzy matches against edit distances of all stretches."""

import random
import re

import duckdb

from atlas_spark.llm import licenses as L
from atlas_spark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SCHEMA = "doc_id bigint, text string, labels string, spans string, score string, n_words int"


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = sorted(i for i, _ in at)
    return len(w), len(at), places[0] if places else None, places[-1] if places else None, ",".join(sorted({x for _, x in at}))


def row(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_query(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op13_license_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert row(r) == base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert sum(r["n_base"] for r in got)


def least_edits(loose, exact, text):
    """Fewest edits of the notice between any two word borders of the normal form, by dynamic programming over all stretches."""
    tail = " " + exact + " " if exact else " "
    best = None
    for a in range(len(text)):
        if text[a] != " ":
            continue
        line = list(range(len(loose) + 1))
        for b in range(a + 1, min(len(text), a + 2 + 2 * len(loose))):
            if text.startswith(tail, b):
                best = line[-1] if best is None else min(best, line[-1])
            new = [line[0] + 1]
            for j, c in enumerate(loose, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (c != text[b])))
            line = new
    return best


def test_bounded_errors():
    """A notice is found if and only if some stretch of the text is within its edits."""
    rng = random.Random(11)
    notices = L.Notices()
    seen = 0
    for k, (_, loose, exact) in enumerate(notices.table):
        for edits in range(notices.edits(k) + 3):
            t = loose
            for _ in range(edits):
                i = rng.randrange(len(t))
                t = rng.choice([t[:i] + t[i + 1:], t[:i] + rng.choice("abc x") + t[i:], t[:i] + rng.choice("abc x") + t[i + 1:]])
            text = L.normal_form(f"some words, {t} {exact}. and more".encode()).decode()
            fewest = least_edits(loose, exact, text)
            found = [m.start() for first_last in [w for w in notices.windows(text) if w[0] == k] for m in notices.patterns[k].finditer(text, max(first_last[1] - notices.edits(k) - 1, 0))]
            assert bool(found) == (fewest is not None and fewest <= notices.edits(k)), (t, fewest)
            seen += bool(found)
    assert seen > 40


def test_spans_and_labels():
    n = L.Notices()
    text = "É. This work is licenced under the GNU Generall Public Licence, version 3.\nAll  rights\treserved"
    *_, labels, score, spans = L.scan(text.encode(), n)
    assert labels == "all-rights-reserved,gpl-3" and score == 1.0
    assert [text[a:b] for _, a, b, _ in spans] == ["GNU Generall Public Licence, version 3", "All  rights\treserved"] and spans[0][3] == 2
    assert L.scan(b"gnu general public license version 9", n)[5] == ""
    assert L.scan(b"GNU General Public License, version 2", n)[5] == "gpl-2"
    many = L.scan(b"Released under the MIT License. " * 5000, n)
    assert many[1] == 5000 and many[2:4] == (1, 24996) and len(many[7]) == 10000


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,"), (None, "x CC-BY-NC"), (None, None), (4, "under the MIT\nlicense under THE mit license"), (4, "under the MIT\nlicense under THE mit license"),
            (5, "cc by nc cc by nc by"), (6, "É" * 100000 + " Apache License, Version 2"), (7, "cc by nc"), (8, "a\x00b cc/by/nc")]
    df = spark.createDataFrame([(i, t, "l", "s", "x", 1) for i, t in docs], SCHEMA)
    got = sorted(map(str, ((r["doc_id"], *row(r)) for r in L.license_scan(df).collect())))
    assert got == sorted(map(str, ((i, *base(t)) for i, t in docs)))
    assert L.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    (score,) = {r["score"] for r in L.license_scan(df).collect() if r["doc_id"] in (1, 2, 3)}
    assert score == 0
