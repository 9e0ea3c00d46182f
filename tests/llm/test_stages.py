"""The stages of the corpus pipeline on small tables: clashing columns, nulls, repeated rows and what each of them keeps."""

import corpus_pipeline as cp
from test_edges import ROWS, WORDS, table

CLASH = ["*", "1 as _score", "2 as _key", "3 as n_lines", "4 as _n_dropped", "5 as _host"]


def test_lines_stage(spark):
    docs = table(spark, [(i, f"Menu\nbody {i}", "h") for i in range(10)] + [(20, "Menu\nx", None), (21, None, "h")]).selectExpr(*CLASH)
    got = cp.drop_boilerplate(spark, docs, "")
    assert got.columns == docs.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text == "body 0" and by[0].n_chars == 6 and by[20].text == "Menu\nx" and by[20].n_chars == 1 and by[21].text is None
    assert all((r.n_lines, r._n_dropped, r._host) == (3, 4, 5) for r in by.values())
    assert cp.drop_boilerplate(spark, docs.drop("n_chars"), "").count() == 12


def test_near_duplicates_stage(spark):
    docs = table(spark, ROWS).selectExpr(*CLASH)
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 4, 5, 6, 7, 8, None, None]  # 2 and 3 copy 1, 9 is 8 in upper case; rows without an id stay


def test_classifier_stage(spark, monkeypatch):
    model = cp.quality.Model(cp.quality.np.zeros(cp.quality.DIM), 0.0, 1.0, 20.0)
    monkeypatch.setattr(cp, "quality_model", lambda spark, sf_dir: model)
    docs = table(spark, [(1, " ".join(WORDS), "a"), (None, None, None)]).selectExpr(*CLASH)
    got = cp.quality_classifier(spark, docs, "")
    assert got.columns == docs.columns and got.count() == 2 and {r._score for r in got.collect()} == {1}
