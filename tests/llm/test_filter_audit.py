"""The subset walk against a document-by-document run of every order."""

from itertools import permutations

import numpy as np

from atlas_spark.llm import filter_audit as A

DOCS = "doc_id bigint, text string, source string, part string, mask int, words int, n int, digest string, good int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def plain(docs, labels):
    """(part, order, step) -> counts, by running every order over the documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, source in docs:
        t = text or ""
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        t = text or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if mine[k][1][f]]
                left = [k for k in alive if not mine[k][1][f]]
                dead = set(range(len(mine))) - set(alive)
                out[part, "".join(order), step] = [len(left), len(gone), sum(mine[k][1][f] for k in dead),
                                                   sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(mine[k][2] for k in gone), sum(mine[k][3] for k in gone)]
                total[f] += len(gone)
                alive = left
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_against_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    half = " ".join(["same"] * 130 + [f"v{i}" for i in range(129)])
    docs = [(1, long, "a"), (2, long, "a"), (2, long, "b"), (1, long, "b"), (3, None, "a"), (4, "", None), (None, long, None), (None, None, "a"), (5, "AB cd", ""), (6, half, "b"), (7, half + " 100%", "b"),
            (8, "x" * 300000, "a"), (9, "A" + long, "a"), (10, "AAAAAA" + long, "c"), (11, "one\x0btwo\x1cthree four", "c"), (12, " \t", "c"), (13, "É" * 98 + "AB", "c"), (14, "É" * 98 + "ABC", "c"), (8, "x" * 300000, "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, 0)]
    got = A.filter_audit(spark.createDataFrame([(*d, "p", 1, 2, 3, "d", 9) for d in docs], DOCS), spark.createDataFrame([(*x, "z") for x in labels], LABELS)).collect()
    want = plain(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r[c] for c in A.COUNTS] == want[r["part"], r["filter_order"], r["step"]], r


def test_empty(spark):
    assert A.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    r = A.filter_audit(spark.createDataFrame([(1, "a", "s", "p", 1, 2, 3, "d", 9)], DOCS), spark.createDataFrame([], LABELS))
    assert r.count() == 600 and r.filter("good_lost + toxic_lost > 0").count() == 0


def test_states_of_any_number_of_filters():
    rng = np.random.default_rng(1)
    for filters in (1, 2, 3, 5):
        cell = rng.integers(0, 9, (1 << filters, 4, 3))
        states = A.survivors(cell)
        for subset in range(1 << filters):
            assert (states[subset] == sum(cell[m] for m in range(1 << filters) if not m & subset)).all()
        assert A.audit(cell)[:, :, :, 1].sum(axis=2).std(axis=1).max() == 0  # every order removes the same documents in all


def test_many_parts(spark):
    docs = [(i, f"text {i % 7}", f"s{i % 230}", "p", 1, 2, 3, "d", 9) for i in range(460)]
    got = A.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert got.count() == 230 * 600 and got.filter("step = 5 and kept <> 0").count() == 0
