"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, on small hand-made tables."""

import base64
import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard

from atlas_spark.llm import bpe, decontaminate, fingerprints as fp, jaccard_join, line_dedup, pii, quality, substring_dedup, text as T, token_counts as tc, warc
from atlas_spark.llm.components import components
from atlas_spark.llm.queries import work_folder

LONG = "word" * 40_000
WORDS = [f"w{i}" for i in range(400)]
A, B = " ".join(WORDS[:120]), " ".join(WORDS[:119] + ["other"])
RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, score double, ids string, sketch string, cell int, g int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 9, 9.0, "x", "y", 1, 2, 3) for i, t, s in rows], SCHEMA)


ROWS = [(1, A, "a"), (2, A, "a"), (2, A, "a"), (3, B, None), (4, None, "a"), (5, "", "b"), (6, LONG, "b"), (None, A, None), (None, None, None), (7, " \t\n ", "b"),
        (8, "two words", "b"), (9, "Two WORDS", "c")]


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_jaccard_join(rows, none):
    got = sorted(map(tuple, jaccard_join.jaccard_join(rows).collect()), key=str)
    assert len(got) == len(ROWS)
    assert sum(r == (2, 116, 1) for r in got) == 2
    assert {(1, 116, 1), (3, 116, 1), (None, 116, 1), (4, 0, 4), (5, 0, 5), (7, 0, 7), (6, 1, 6), (None, 0, None), (8, 1, 8), (9, 1, 8)} <= set(got)
    assert jaccard_join.jaccard_join(none).count() == 0


def test_large_group_of_near_copies(spark):
    """More members than a block, linked in a chain of small changes."""
    n = 600
    base = [f"b{i}" for i in range(100)]
    docs = [(k, " ".join(base + [f"u{k}"]), "s") for k in range(n)] + [(n + k, " ".join(f"z{k}{i}" for i in range(60)), "s") for k in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(table(spark, docs), 3, 90).collect()}
    assert all(got[k] == 0 for k in range(n)) and all(got[n + k] == n + k for k in range(20))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 201), (None, 5), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[201] == 200 and got[300] == 300
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_line_dedup(spark, none):
    docs = table(spark, [(i, f"Menu\nbody {i}\n\nMenu", "h") for i in range(10)] + [(20, "Menu\nx", None), (21, None, "h"), (22, "", "h"), (23, LONG, "g")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs, "source").collect()}
    assert got[0] == ("body 0\n", 4, 2) and got[20] == ("Menu\nx", 2, 0) and got[21] == (None, 0, 0) and got[22] == ("", 1, 0) and got[23][0] == LONG
    assert line_dedup.line_dedup(none, "source").count() == 0


def test_line_dedup_rule(spark):
    """Against a plain version on hosts of every size from 1 to 40 pages, and with columns named like the helpers'."""
    rng = random.Random(8)
    docs = [(h * 100 + i, "\n".join(f"line {rng.randrange(40)}" for _ in range(3)) + f"\nown {h} {i}", f"h{h}") for h in range(1, 41) for i in range(h)]
    pages, holding = Counter(s for _, _, s in docs), Counter((s, x) for _, t, s in docs for x in set(t.split("\n")))
    want = {i: "\n".join(x for x in t.split("\n") if not holding[s, x] - 1 > line_dedup.RATIO * pages[s]) for i, t, s in docs}
    clash = table(spark, docs).selectExpr("*", "1 as _host", "2 as _boiler", "3 as _all", "4 as _KEPT", "5 as n_lines", "6 as __host")
    got = line_dedup.line_dedup(clash, "source")
    assert {r.doc_id: r.text for r in got.collect()} == want and 0 < sum(want[i] != t for i, t, _ in docs) < len(docs)
    assert got.columns == [*[c for c in clash.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert {(r._host, r._boiler, r._all, r._KEPT) for r in got.collect()} == {(1, 2, 3, 4)}


def test_foreign_archive():
    """Base32 digests, an HTTP response block and unknown algorithms as other writers give them; wrong lengths and digests are found."""
    body = b"<p>body</p>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body

    def digest(data):
        return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    def made(*lines, data=block, kind="application/http; msgtype=response"):
        head = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {kind}", f"Content-Length: {len(data)}", *lines]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + data + b"\r\n\r\n"
    headers, got = warc.parse_record(made("WARC-Block-Digest: " + digest(block), "WARC-Payload-Digest: " + digest(body)))
    assert got == block and warc.payload_of(headers, got) == body
    warc.parse_record(made("WARC-Payload-Digest: sha256:" + hashlib.sha256(body).hexdigest(), "WARC-Block-Digest: blake9:xyz"))
    for wrong in ("WARC-Block-Digest: " + digest(body), "WARC-Payload-Digest: " + digest(block), f"X-Payload-Length: {len(block)}", "WARC-Payload-Digest: md5:00"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(made(wrong))


def test_archive_sample(spark):
    """The dictionary's sample is fetched by hash: repeated rows and payloads count once, extra columns are not read."""
    pages = spark.createDataFrame([(i // 2, "u", f"<p>{i // 4} " + "word " * (20 + i % 7) + "</p>") for i in range(800)], "page_id bigint, url string, html string")
    d = warc.payloads(pages.selectExpr("*", "1 as h", "2 as digest", "3 as keeper"))
    assert d.columns == ["page_id", "url", "payload"] and len(warc.train_dictionary(d)) > 0
    assert warc.train_dictionary(d.limit(0)) == b""


def test_shrunk_texts(spark):
    texts = ["", "é" * 3_000_000, "a b c", "x" * 5_000_000, "last"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None), (None, "n")], "doc_id bigint, text string").coalesce(1)
    z = substring_dedup._small(d)
    got = z.mapInArrow(lambda b: substring_dedup._whole(b), "text string, doc_id bigint").collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts))


def test_token_counts(spark, rows, none):
    ledger = tc.Ledger(spark, work_folder(spark, "t"))
    assert ledger.totals().count() == 0
    words = {"v": tc.COUNTERS["words-1"]}
    assert ledger.commit("a", tc.changes(rows, words)) and not ledger.commit("a", tc.changes(rows, words))
    assert ledger.commit("none", tc.changes(none, words))
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.totals().collect()}
    assert got == {("a", "en"): (4, 360), (None, "en"): (3, 240), ("b", "en"): (4, 3), ("c", "en"): (1, 2)}
    ledger.commit("b/2", tc.revisions(rows, "v", tc.COUNTERS["words-1"], lambda t: tc.COUNTERS["words-1"](t) * 2))
    ledger.commit("c", tc.changes(rows.filter("source = 'c'"), {"v": lambda t: tc.COUNTERS["words-1"](t) * 2}, -1))
    assert {r.source: r.tokens for r in ledger.totals().collect()} == {"a": 720, None: 480, "b": 6}


def test_fingerprints(spark, rows, none):
    got = fp.fingerprints(rows).collect()
    assert len(got) == len(ROWS) and fp.fingerprints(none).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].sketch == by[2].sketch != [] and by[4].sketch == [] == by[5].sketch == by[7].sketch
    assert by[8].sketch == by[9].sketch and len(by[8].sketch) == 1
    assert by[6].edited == LONG[:120_000] + " \t\n "
    one = fp.fingerprints(table(spark, [(1, "abcdefgh", "s")])).first()
    assert one.edited == "abcdefab"
    # ranges of a few rows: the first row of a range follows the last one before it
    many = table(spark, [(i * i, f"{i:03d} text", "s") for i in range(50)]).select("doc_id", "text")
    assert {r.doc_id: r.next_text for r in fp.with_next(many, ["text"], 4).collect()} == {i * i: f"{(i + 1) % 50:03d} text" for i in range(50)}


def test_sketches_merge(spark):
    a, b = " ".join(WORDS[:200]), " ".join(WORDS[150:400])
    d = spark.createDataFrame([(a, b, " ".join(WORDS[:200]) + " " + " ".join(WORDS[150:400]))], "a string, b string, c string")
    from pyspark.sql import functions as F
    s = {c: fp.sketch_of(fp.word_hashes(F.col(c))) for c in "abc"}
    r = d.select(fp.merged(s["a"], s["b"]).alias("m"), s["c"].alias("c"), fp.containment(s["a"], s["c"]).alias("x")).first()
    assert set(r.m) <= set(r.c) | set(r.m) and len(set(r.c) - set(r.m)) <= 4 and r.x >= 0.95


def test_warc(spark):
    big = "<p>" + "payload " * 300
    pages = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "é", LONG)]
    path = work_folder(spark, "w")
    warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path)
    got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(pages)
    assert got["<urn:page:1>"].record_type == "revisit" and got["<urn:page:1>"].refers_to == "<urn:page:9>" and got["<urn:page:1>"].payload_bytes == len(big)
    assert bytes(got["<urn:page:9>"].block) == big.encode() and got["<urn:page:none>"].record_type == "response"
    assert got["<urn:page:5>"].payload_digest == hashlib.sha1(b"").hexdigest() and got["<urn:page:3>"].record_type == "response"
    empty = work_folder(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reader_refuses_bad_archives():
    good = warc.record(1, "http://a", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None)
    raw = b"some shared words " * 20
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    lead = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw
    packed = zstandard.ZstdCompressor().compress(raw)
    for data in (lead + z.compress(good), struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + z.compress(good) + struct.pack("<II", warc.SKIP_MAGIC, 1) + b"\n"):
        assert [b for _, b in warc.read_archive(data)] == [b"x" * 50]
    frame = zstandard.ZstdCompressor().compress
    for data in (frame(good)[:-3], frame(good.replace(b"Content-Length: 50", b"Content-Length: 51")), frame(good.replace(b"WARC/1.1", b"HTTP/1.1")),
                 frame(good.replace(b"x" * 50, b"y" * 50)), frame(good.replace(b"WARC-Type: response\r\n", b"")), frame(good) + b"abc", b"plain text that is no frame",
                 struct.pack("<II", warc.DICT_MAGIC, 99) + b"short"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data))


def test_pii(rows, none):
    assert pii.pii(none).count() == 0 and pii.pii(rows).count() == len(ROWS)
    kinds = lambda t: [(pii.KINDS[k], t[a:b]) for a, b, k, _ in pii.find(t)]
    assert kinds("a@b.c_d@e.fr x@y") == [("email", "a@b.c"), ("email", "_d@e.fr")]
    assert kinds("1.2.3.4.5.6.7.8 256.1.1.1 é 010.0.0.1") == [("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "010.0.0.1")]
    assert kinds("4111 1111-1111 1111 and 4111 1111 1111 1112") == [("card", "4111 1111-1111 1111")]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32, GB82 WEST 1234 5698 7654 33") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("+49 (30) 1234-5678.") == [("phone", "+49 (30) 1234-5678")]
    near, far = pii.find("my card 4111111111111111"), pii.find("my shoe 4111111111111111")
    assert near[0][3] > far[0][3]
    assert pii.find("9" * 200_000) == [] and pii.find("+" * 100_000 + "1(" * 50_000) == [] and pii.find("@" * 100_000 + "a" * 100_000 + "@") == []


def test_bpe(rows, none):
    got = bpe.bpe(rows, RANKS, P.PATTERN, ids=True).collect()
    assert len(got) == len(ROWS) and all(r.decoded_equal for r in got) and bpe.bpe(none, RANKS, P.PATTERN).count() == 0
    assert all(r.n_tokens == len(r.ids) for r in got) and {r.n_tokens for r in got if not r.text} == {0}


def test_bpe_equals_merging_by_hand():
    """Random bytes and long pieces, against the rule itself."""
    v = bpe.Vocabulary(RANKS)

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((v.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return [v.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in [1, 2, 3, 5, 9, 17, 40, 130, 256, 257, 700] for _ in range(6)]
    pieces += [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (3, 10, 100, 300)] + [b"a" * 300, b" " * 256, b"ab" * 128]
    want = [[v.ranks[p]] if p in v.ranks else plain(p) for p in pieces]
    assert [x.tolist() for x in v.encode_pieces(pieces)] == want
    assert len(v.encode_pieces([b"the" * 60_000])[0]) > 0


def test_quality(spark, rows, none):
    good, bad = [" ".join(WORDS[i:i + 30]) for i in range(40)], ["### $$$ " * 20 + str(i) for i in range(40)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(None, 1), (3, None), (5, 7)], "doc_id bigint, label int")
    model = quality.fit(quality.sampled(docs, labels))
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all((got[i] > 0.7) == (i < 40) for i in range(80))
    out = quality.scored(rows, model).collect()
    assert len(out) == len(ROWS) and len({r.score for r in out if not r.text}) == 1 and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in quality.scored(rows, quality.fit(quality.sampled(none, labels))).collect()] == [0.5] * len(ROWS)


def test_decontamination(spark, rows, none):
    item = "the quick brown fox jumps over the lazy dog today. And the answer is forty two."
    w = item.split()
    docs = table(spark, [(1, f"{A} {item} {A}", "s"), (1, f"{A} {item} {A}", "s"), (2, A, "s"), (None, item, "s"), (3, None, "s"), (4, "", "s"),
                         (5, " ".join(w[:4] + ["auburn"] + w[5:]), "s"), (6, LONG, "s")])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, "")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (5, 1)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [2, 3, 4, 6]
    assert decontaminate.leaks(none, bench).count() == 0 == decontaminate.leaks(rows, bench.limit(0)).count()
    assert decontaminate.without_leaks(rows, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.lcs([1, 2, 3, 4], [2, 9, 4, 1]) == 2


def test_substring_dedup(spark, rows, none):
    assert substring_dedup.substring_dedup(none).count() == 0
    p = ". ".join(" ".join(f"p{k}{i}" for i in range(12)) for k in range(6)) + "."
    edited = p.replace("p55", "changed")
    docs = table(spark, [(1, "start of one text " + p + " and its end", "s"), (2, "another start " + p + " another end", "s"), (3, "third beginning here " + edited, "s"),
                         (4, "nothing in common with the others at all here", "s"), (5, None, "s"), (None, p, "s")])
    got = {}
    for r in substring_dedup.substring_dedup(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, 2, 3} and not any(r.removed for r in got[1]) and all(r.removed for r in got[2])
    t = "another start " + p + " another end"
    assert t[got[2][0].start:got[2][0].end].startswith("p10") and sum(r.words for r in got[2]) == 48
    assert all(r.doc_id in (1, 2, 3) for r in substring_dedup.substring_dedup(rows).collect())
    rows_, bands = substring_dedup.tuned_bands(0.8, 0.99)
    assert 1 - (1 - 0.8 ** rows_) ** bands >= 0.99


def test_iban_before_upper_case_words():
    found = lambda t: [t[a:b] for a, b, k, _ in pii.find(t) if pii.KINDS[k] == "iban"]
    es, be = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034"
    assert found(f"{es} BANK") == [es] and found(f"{be} BIC") == [be] and found(f"{be} {es} OK") == [be, es]
    assert found("ES91 2100 0418 4502 0005 1333 BANK") == [] and found(es.replace(" ", "")) == [es.replace(" ", "")]


def test_partial_quotes_and_short_items(spark):
    """47 of 59 words, 159 of 200, a window with changed words, and items of two to seven words, all exactly."""
    rng = np.random.default_rng(3)

    def fill(n):
        return [f"q{x}" for x in rng.integers(0, 1 << 40, n)]
    items = [fill(59), fill(200), fill(120), fill(7), fill(2), fill(12)]
    changed = items[2][24:54]
    changed[4], changed[15], changed[22] = "x", "y", "z"
    quotes = [items[0][6:53], items[1][20:179], changed, items[3], items[4], items[1][20:39], items[3][:6], items[5]]
    docs = [(k, " ".join(fill(40) + q + fill(50)), "s") for k, q in enumerate(quotes)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, docs), bench).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 5)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table(spark, docs), bench).collect()) == [5, 6]


def test_repeated_runs_without_stops(spark):
    """Run by run: long sentences, passages pasted inside one, lists, other scripts' stops; ends short of the run by REACH - 1 words at most."""
    rng = np.random.default_rng(5)

    def fill(n):
        return " ".join(f"v{x}" for x in rng.integers(0, 1 << 40, n))
    runs, docs = {}, []
    for k, n in enumerate([20, 51, 55, 60, 76, 51, 52, 120]):
        p = fill(n).split()
        if k in (3, 4):
            p[n // 2 - 1] += "."  # two long sentences, both cut by the borders of the passage
        p = (" \u3002" if k == 5 else "\n" if k == 6 else "  ").join(p)
        runs[k] = p
        docs += [(10 * k + i, f"{fill(30 + 7 * i)}   {p} {fill(33)}", "s") for i in (1, 2)]
    docs.append((99, fill(300), "s"))
    text = {i: t for i, t, _ in docs}
    got = {}
    for r in substring_dedup.substring_dedup(table(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    slack = substring_dedup.REACH - 1
    assert 99 not in got
    for k, p in runs.items():
        n, size = len(p.split()), 0
        for i in (1, 2):
            spans = got.get(10 * k + i, [])
            if n >= 20 + 2 * slack:
                assert len(spans) == 1 and spans[0].removed == (i == 2)
                inner = text[10 * k + i][spans[0].start:spans[0].end]
                assert inner in p and inner == inner.strip() and len(inner.split()) == spans[0].words >= n - 2 * slack
                size += 1
        assert size == (2 if n >= 51 else 0)


def test_seeds_depend_on_nearby_words_only():
    rng = np.random.default_rng(6)
    runs = [rng.integers(0, 1 << 40, substring_dedup.SPAN) for _ in range(300)]
    text = [" ".join(map(str, [*rng.integers(0, 1 << 40, 15), *r, *rng.integers(0, 1 << 40, 15)])) for r in runs for _ in range(2)]
    w = T.words(pa.array(text + ["a " * 50, "b", ""]))
    at, ids = substring_dedup.seeds(w)
    own = np.searchsorted(w.first, at, "right") - 1
    assert all(set(ids[own == 2 * i]) & set(ids[own == 2 * i + 1]) for i in range(300)) and len(set(ids[own == 600])) == 1
    assert len(at) < 0.35 * len(w.hash) and (ids < 0).all()


def test_removed_and_kept_words_do_not_overlap(spark):
    """The middle of a kept passage was in an earlier text, so only its ends are kept."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    docs = [(1, " ".join(b), "s"), (2, " ".join(a + b + c), "s"), (3, " ".join(a + b + c), "s")]
    got = sorted((r.doc_id, r.start, r.end, r.removed, r.words) for r in substring_dedup.substring_dedup(table(spark, docs)).collect())
    assert [(d, x) for d, _, _, x, _ in got] == [(1, False), (2, False), (2, True), (2, False), (3, True)]
    for d, s, e, _, n in got:
        assert len(docs[d - 1][1][s:e].split()) == n and docs[d - 1][1][s:e].strip() == docs[d - 1][1][s:e]
    assert all(x[2] < y[1] for x, y in zip(got[1:], got[2:4])) and sum(x[4] for x in got[1:4]) == 120


def test_words_and_shingles():
    w = T.words(pa.array(["The cat\tsat", None, "", "the CAT", "é É"]))
    assert w.first.tolist() == [0, 3, 3, 3, 5, 7] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[4] and w.hash[5] != w.hash[6]
    h, off = T.shingles(w, 2)
    assert off.tolist() == [0, 2, 2, 2, 3, 4] and h[0] == h[2]


def test_links_at_the_border_of_the_length_test(spark):
    """Sets of 90 and 100 shingles link at 90 percent, those of 89 and 100 do not, also where they share frequent lists with others."""
    docs = [(100 * k + n, " ".join(f"k{k}x{i}" for i in range(n + 2)), "s") for k in range(4) for n in (100, 90, 89, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, docs), 3, 90).collect()}
    for k in range(4):
        assert [got[100 * k + n][0] for n in (100, 90, 89, 40)] == [100, 90, 89, 40]
        # 89 links with 90, and so reaches 100
        assert len({got[100 * k + n][1] for n in (100, 90, 89)}) == 1 and got[100 * k + 40][1] == 100 * k + 40
    two = [(n, " ".join(f"x{i}" for i in range(n + 2)), "s") for n in (100, 89)]
    assert {r.component_id for r in jaccard_join.jaccard_join(table(spark, two), 3, 90).collect()} == {100, 89}


def test_components_stop_at_stars_only(spark):
    """A star is final at once; a node with two smaller neighbours, or with smaller and larger ones, is not."""
    for edges in ([(5, 1), (6, 1), (9, 8)], [(5, 1), (5, 2)], [(5, 1), (9, 5)], [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]):
        root = {}
        for a, b in edges:
            ra, rb = root.get(a, a), root.get(b, b)
            nodes = {n for n, r in root.items() if r in (ra, rb)} | {a, b}
            root |= {n: min(ra, rb) for n in nodes}
        assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == root


def test_partial_copies_form_no_family(spark, monkeypatch):
    """A chain of 30 texts, each half of the next one, links nothing and is not compared as one family; two near copies still are."""
    rng = np.random.default_rng(5)
    half = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 9, 100)) for _ in range(31)]
    docs = [(i, f"{half[i]} {half[i + 1]}", "s") for i in range(30)] + [(90, f"{half[4]} {half[5]} end", "s")]
    sizes = []

    def seen(*args, real=jaccard_join.families):
        fam = real(*args)
        sizes.extend(r["count"] for r in fam.groupBy("fam").count().collect())
        return fam
    monkeypatch.setattr(jaccard_join, "families", seen)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(table(spark, docs).repartition(31), 3, 90).collect()}
    assert got == {**{i: i for i in range(30)}, 90: 4}
    assert sizes == [2]
