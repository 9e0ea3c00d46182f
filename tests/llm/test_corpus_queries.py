"""Queries over the given tables against SQL or a plain version of the same rules."""

import base64
import collections
import hashlib
import os
import re

import public_tokenizers as P
import pytest
import tiktoken
import zlib

from atlas_spark.llm.queries import ORACLES, QUERIES
from check import compare, connect

DIR = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("select doc_id, coalesce(text, '') as text from documents order by doc_id").fetchall()


def rows(spark, key):
    return [r.asDict() for r in QUERIES[key](spark, DIR).collect()]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, con, key):
    message, same = compare(spark, con, DIR, QUERIES[key], ORACLES[key])
    assert same, message


def shingles(text, n):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_fingerprints")}
    assert len(got) == len(docs)
    off = []
    for (i, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]]):
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append(abs(r["near_edited"] - likeness(shingles(t, 5), shingles(edited, 5))))
        assert 0 <= r["near_next"] <= 1
        off.append(abs(r["near_next"] - likeness(shingles(t, 5), shingles(nxt, 5))))
    assert sum(off) / len(off) < 0.08
    same = collections.defaultdict(set)
    for i, t in docs:
        same[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_bpe(spark, docs):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(spark, "op6_bpe")}
    for i, t in docs:
        ids = enc.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_quality(spark, con):
    label = dict(con.sql("select doc_id, quality from labels").fetchall())
    got = rows(spark, "op7_quality")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                  "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_pii(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op8_pii")}
    found = 0
    for i, t in docs:
        want = base_spans(t)
        found += len(want)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("iban")] == want
        assert all(got[i][f"n_{k}"] == sum(s.startswith(k) for s in want) for k in BASE)
    assert found


def components_of(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    holds = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holds[s].append(i)
    pairs = {(a, b) for v in holds.values() for x, a in enumerate(v) for b in v[x + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op9_jaccard_join")}
    assert got == components_of(docs, 3, 90)


def test_decontamination(spark, con, docs):
    items = con.sql("select item_id, text from benchmark").fetchall()
    grams = collections.defaultdict(set)
    for k, t in items:
        w = WORD.findall(t.translate(LOWER))
        for j in range(len(w) - 7):
            grams[tuple(w[j:j + 8])].add(k)
    want = set()
    for i, t in docs:
        w = WORD.findall(t.translate(LOWER))
        hit = collections.Counter(k for j in range(len(w) - 7) for k in grams.get(tuple(w[j:j + 8]), ()))
        want |= {(i, k) for k, c in hit.items() if c >= 0.9 * (len(WORD.findall(dict(items)[k])) - 7)}
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op10_decontamination")}
    assert want <= got and len(got) <= 1.2 * len(want) + 2


def test_substring_dedup(spark, docs):
    """Every run of 60 words that two texts share is inside a span of both but for its first words; no span is in a text that shares nothing."""
    spans = collections.defaultdict(list)
    for r in rows(spark, "op5_substring_dedup"):
        spans[r["doc_id"]].append((r["start"], r["end"]))
    seen, far = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in docs:
        w = WORD.findall(t.translate(LOWER))
        for j in range(len(w) - 59):
            seen[tuple(w[j:j + 60])].add(i)
        for j in range(len(w) - 4):
            far[tuple(w[j:j + 5])].add(i)
    repeated = set().union(*([v for v in seen.values() if len(v) > 1] or [set()]))
    missed = repeated - set(spans)
    assert len(missed) <= 0.02 * len(repeated), sorted(missed)
    assert repeated
    # a document with a span repeats five words of another one, or of its own
    text = dict(docs)
    for i in spans:
        w = WORD.findall(text[i].translate(LOWER))
        g = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        assert any(len(far[x]) > 1 for x in g) or len(set(g)) < len(g)
