"""One query per operator of the subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from . import bpe, decontaminate, filter_audit, fingerprints as fp, jaccard_join, licenses, line_dedup, pii, quality, spelling, substring_dedup, token_counts as tc, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
HELD_OUT = 2
KEEP = 0.7


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PIECES = r"[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]"
_REVISED = r"[^\x20\x09-\x0D]*[0-9A-Za-z][^\x20\x09-\x0D]*"


@query("op1_token_counts", rf"""
with d as (select source, lang, coalesce(text, '') as text from documents
           where doc_id is null or doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)),
n as (select source, lang, 'words-1' as version, len(regexp_extract_all(text, '{_REVISED}')) as n from d
      union all select source, lang, 'pieces-2', len(regexp_extract_all(text, '{_PIECES}')) from d)
select source, lang, version, count(*)::bigint as docs, sum(n)::bigint as tokens from n group by all""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, one version's counts are revised, toxic documents are withdrawn; each batch is sent twice."""
    folder = work_folder(spark, "token-counts")
    tc.counted(table(spark, sf_dir, "documents"), tc.COUNTERS | {"revised": tc.REVISED}, "doc_id").write.parquet(f"{folder}/counts")
    counts, labels = spark.read.parquet(f"{folder}/counts"), table(spark, sf_dir, "labels")
    toxic = counts.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    ledger = tc.Ledger(spark, folder)
    batches = {"load": lambda: tc.signed(counts, [(v, v, 1) for v in tc.COUNTERS]),
               "revise words-1": lambda: tc.signed(counts, [("words-1", "words-1", -1), ("words-1", "revised", 1)]),
               "withdraw toxic": lambda: tc.signed(toxic, [("words-1", "revised", -1), ("pieces-2", "pieces-2", -1)])}
    for name, delta in batches.items():
        for _ in range(2):
            ledger.commit(name, delta())
    return ledger.totals()


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fp.fingerprints(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return d.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), fp.printed(own).alias("fingerprint"),
                    fp.printed(edited).alias("edited_fingerprint"), fp.likeness(own, edited).alias("near_edited"), fp.likeness(own, following).alias("near_next"),
                    fp.containment(own, edited).alias("contained_edited"), fp.containment(own, following).alias("contained_next"))


@query("op3_line_dedup", f"""
with page as (select row_number() over () as r, doc_id, source, text, string_split(text, chr(10)) as l from documents),
pages as (select source, count(*) as n from page group by source),
held as (select source, line, count(*) as c from (select distinct r, source, unnest(l) as line from page) where line <> '' group by all),
boiler as (select h.source as s, list(line) as b from held h join pages p on h.source is not distinct from p.source
           where c - 1 > {line_dedup.RATIO} * n group by all),
kept as (select doc_id, source, text, l, list_filter(l, lambda x: x = '' or not coalesce(list_contains(b, x), false)) as k
         from page left join boiler on source is not distinct from s)
select doc_id, source, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(l) - len(k), 0)::bigint as n_dropped,
       case when text is not null then sha256(array_to_string(k, chr(10))) end as kept_sha256 from kept""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents"), "source")
    return d.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


@query("op4_warc", """
with p as (select page_id, coalesce(html, '') as html, encode(coalesce(html, '')) as b from pages),
k as (select html, max(page_id) as keeper from p where octet_length(b) >= 1000 group by html),
j as (select p.page_id, octet_length(b) as n, sha1(b) as digest, case when page_id < keeper then keeper end as refers_to from p left join k using (html))
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from j""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    d = warc.read_archives(spark, path)

    def page(c):
        return F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    return d.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text", "decoded_equal")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Trained on rows of ``labels`` outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = table(spark, sf_dir, "labels").filter(fold != HELD_OUT).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(quality.sampled(table(spark, sf_dir, "documents"), labels))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.pii(table(spark, sf_dir, "documents"))

    def printed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))

    def of(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in pii.BASE]
    return d.select("doc_id", *counts, F.sha2(F.encode(printed(base), "utf-8"), 256).alias("base_sha256"), printed(F.col("found")).alias("spans"),
                    F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_filter_audit", r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
f as (select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
      coalesce(doc_id > min(doc_id) over (partition by text), false) as e from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
      from f left join l using (doc_id) group by all),
letter as (select i, chr((65 + i)::int) as c from range(5) t(i)),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.i, b.i, c.i, d.i, e.i] as ix from letter a, letter b, letter c, letter d, letter e
      where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select filter_order, step, 1 << ix[step]::int as bit, list_sum([0] || list_transform(ix[:step - 1], lambda x: 1 << x::int)) as before from o, range(1, 6) t(step)),
r as (select part, filter_order, step, bit, sum(n) filter (where mask & bit = 0 and mask & before::int = 0) as kept,
      sum(n) filter (where mask & bit > 0 and mask & before::int = 0) as removed, sum(n) filter (where mask & bit > 0 and mask & before::int > 0) as redundant,
      sum(n) filter (where mask = bit) as unique_fails, sum(good) filter (where mask & bit > 0 and mask & before::int = 0) as good_lost,
      sum(toxic) filter (where mask & bit > 0 and mask & before::int = 0) as toxic_lost from m, s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       sum(coalesce(removed, 0)) over (partition by part, bit)::bigint as shapley from r""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.license_scan(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string")))
    return d.withColumn("spans", F.array_join(spans, ","))
