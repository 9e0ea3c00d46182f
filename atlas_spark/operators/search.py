"""Gene and text search, answered for a table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .ranking import HOT_ROWS, grouped_ranks
from .relational import few_keys, top_n

TOP = 100
#: Postings of a block and folders of the stored index.
BLOCK = 10_000
PARTS = 32
#: Tasks that a folder is dealt to, at most.
SLICES = 16
NO_WORD = r"[^\p{L}\p{N}]+"


def gene_search(queries: DataFrame, designs: DataFrame, uniprot: DataFrame, ready_lines: DataFrame | None = None) -> DataFrame:
    """(query, kind, id): designs whose target has the name, and ensg ids listing it among their genes."""
    q = queries.select("query", F.upper(F.trim("query")).alias("_q")).distinct()
    d = designs if ready_lines is None else designs.join(ready_lines, "design_id", "left_semi")
    targets = q.join(d.select(F.upper("target_name").alias("_q"), F.col("design_id").cast("string").alias("id")), "_q")
    names = uniprot.filter("ensg_id is not null").select(F.explode(F.split(F.upper("gene_names"), " ")).alias("_q"), F.col("ensg_id").alias("id")).distinct()
    return (targets.select("query", F.lit("target").alias("kind"), "id")
            .unionByName(q.join(names, "_q").select("query", F.lit("ensg").alias("kind"), "id")))


def resolve_alias(queries: DataFrame, nomenclature: DataFrame) -> DataFrame:
    """(query, symbol): the approved symbol, else the symbol that lists the query as previous or alias name."""
    q = queries.select("query").distinct()
    exact = nomenclature.select(F.col("symbol").alias("query"), F.col("symbol").alias("_e")).distinct()
    words = F.concat(F.coalesce(F.split("prev_symbol", "[|]"), F.array().cast("array<string>")),
                     F.coalesce(F.split("alias_symbol", "[|]"), F.array().cast("array<string>")))
    alias = nomenclature.select("symbol", F.explode(words).alias("query")).groupBy("query").agg(F.min("symbol").alias("_a"))
    return q.join(exact, "query", "left").join(alias, "query", "left").select("query", F.coalesce("_e", "_a").alias("symbol"))


def prefix_search(queries: DataFrame, uniprot: DataFrame, longest: int = 20) -> DataFrame:
    """(query, ensg_id, relevance): ensg ids with a gene name starting with the query.

    Every name offers its prefixes as keys, so the lookup is an equality join.
    """
    q = queries.select("query", F.upper("query").alias("_q")).distinct()
    names = uniprot.filter("ensg_id is not null").select("ensg_id", F.explode(F.split(F.upper("gene_names"), " ")).alias("_n")).distinct()
    short, long_ = q.filter(F.length("_q") <= longest), q.filter(F.length("_q") > longest)
    keys = names.select("ensg_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("_n"), F.lit(longest))),
                                                         lambda k: F.substring(F.col("_n"), F.lit(1), k))).alias("_q"))
    # longer queries meet on their first letters and are compared in full
    head = names.filter(F.length("_n") > longest).withColumn("_h", F.substring("_n", 1, longest))
    far = long_.withColumn("_h", F.substring("_q", 1, longest)).join(head, "_h").filter(F.col("_n").startswith(F.col("_q")))
    return (short.join(keys, "_q").select("query", "ensg_id").unionByName(far.select("query", "ensg_id")).distinct()
            .withColumn("relevance", F.lit(1.0)))


def token_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Inverted table (id, token, tf, n_tokens) over whole texts.

    The words of a text are counted inside its row, by their runs once they are sorted; texts meet in a group only where ids are repeated.
    """
    words = F.sort_array(F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != ""))
    t = docs.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("n_tokens", F.size("w"))
    first = F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i))
    t = t.withColumn("_first", F.filter(first, lambda i: i.isNotNull()))
    runs = F.transform("_first", lambda i, k: F.struct(F.get("w", i).alias("token"), (F.coalesce(F.get("_first", k + 1), F.col("n_tokens")) - i).cast("bigint").alias("tf")))
    t = t.select("id", "n_tokens", F.inline(runs))
    if docs.groupBy(id_col).agg(F.count("*").alias("_c")).filter("_c > 1").isEmpty():
        return t
    return t.groupBy("id", "n_tokens", "token").agg(F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class TextIndex:
    """Stored postings (token, block, id, tf, n_tokens) and their blocks (token, block, n, top).

    The postings of a word are cut into blocks of ``block`` entries by falling share of the word in its document, ``top`` being
    the largest share in a block; a common word is thus spread over many blocks, files and tasks.
    """
    spark: SparkSession
    path: str
    id_type: str
    parts: int = PARTS

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, n_tokens int, token string, tf bigint, share double, block bigint, part int").parquet(f"{self.path}/postings")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("token string, block bigint, n bigint, top double").parquet(f"{self.path}/blocks")


def build_text_index(docs: DataFrame, id_col: str, text: str, path: str, block: int = BLOCK, parts: int = PARTS, hot_rows: int = HOT_ROWS) -> TextIndex:
    """Write the index of whole texts below ``path``, a folder that all executors share; the texts are read once.

    The postings cross one shuffle, which sorts them as they are stored and so numbers them as well; those of words with more than
    ``hot_rows`` are ranked in pieces.
    """
    spark = docs.sparkSession
    t = token_table(docs, id_col, text)
    t.write.mode("overwrite").parquet(f"{path}/words")
    t = spark.read.schema(t.schema).parquet(f"{path}/words").withColumn("share", F.col("tf") / F.col("n_tokens"))
    t = t.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    hot = cut_lineage(t.groupBy("token").agg(F.count("*").alias("_f")).filter(F.col("_f") > hot_rows).select("token"))
    cold = t if hot.isEmpty() else t.join(F.broadcast(hot), "token", "left_anti")  # one hot word in hot_rows postings at most
    cold = cold.withColumn("slice", F.pmod(F.xxhash64("token", F.lit(1)), F.lit(SLICES))).repartition("part", "slice")
    rank = F.row_number().over(W.partitionBy("part", "slice", "token").orderBy(F.desc("share"), "id", "n_tokens"))
    of = lambda r: F.floor((r - 1) / block).alias("block")
    kept = ["id", "n_tokens", "token", "tf", "share"]
    cold.select(*kept, of(rank), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    if not hot.isEmpty():
        ranked = grouped_ranks(t.join(F.broadcast(hot), "token", "left_semi").withColumn("_minus", -F.col("share")), ["token"], "_minus", ["id", "n_tokens"], out="_r", hot_rows=hot_rows)
        rows = ranked.select(*kept, of(F.col("_r")), "part").repartition("part", F.pmod("block", F.lit(64))).sortWithinPartitions("token", "block", F.desc("share"))
        rows.write.mode("append").partitionBy("part").parquet(f"{path}/postings")
    index = TextIndex(spark, path, dict(docs.dtypes)[id_col], parts)
    index.postings.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("share").alias("top")).write.mode("overwrite").parquet(f"{path}/blocks")
    return index


def fulltext_search(queries: DataFrame, index: TextIndex, top: int = TOP) -> DataFrame:
    """(query, id, relevance): documents with every query word, by term frequency over length; ``top`` per query, ties by id.

    Candidates come from the blocks of each query's rarest word, the best block first; the other words are looked up by
    (word, document), among the postings of the words still asked.  A query ends once its worst kept document beats what the next block can hold at most: the
    block's largest share and the largest shares of the other words.  Each round reads as many blocks as all before it.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("query"), NO_WORD), lambda w: w != ""))
    asked = queries.select("query").distinct().withColumn("_w", words).select("query", F.size("_w").alias("_n"), F.explode("_w").alias("token"))
    blocks, postings = index.blocks, index.postings
    of = blocks.groupBy("token").agg(F.sum("n").alias("_f"), F.max("top").alias("_top"), F.count("*").alias("_blocks"))
    known = asked.join(of, "token")
    plan = known.groupBy("query").agg(F.count("*").alias("_k"), F.max("_n").alias("_n"), F.min(F.struct("_f", "token", "_top", "_blocks")).alias("_r"), F.sum("_top").alias("_all"))
    plan = cut_lineage(plan.filter("_k = _n").select("query", "_n", F.col("_r.token").alias("token"), (F.col("_all") - F.col("_r._top")).alias("_others"), F.col("_r._blocks").alias("_blocks")))
    asked = cut_lineage(asked.join(plan.select("query"), "query", "left_semi"))
    parts = [r[0] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(index.parts)).cast("int").alias("part")).distinct().collect()]
    postings = postings.filter(F.col("part").isin(parts))  # at most as many numbers as folders; folders without an asked word are not read
    kept, done, first, last = None, [], 0, 1
    while True:
        tokens = few_keys(asked.join(plan.select("query"), "query", "left_semi").select("token").distinct())
        wanted = plan.select("query", "token", F.explode(F.sequence(F.lit(first).cast("bigint"), F.least(F.lit(last), "_blocks") - 1)).alias("block"))
        cand = postings.select("token", "block", "id").join(few_keys(wanted), ["token", "block"]).select("query", "id").distinct()
        hit = (cand.join(asked, "query").join(postings.select("token", "id", "n_tokens", "tf").join(tokens, "token", "left_semi"), ["token", "id"]).groupBy("query", "_n", "id", "n_tokens")
               .agg(F.count("*").alias("_m"), F.sum("tf").alias("_tf")))
        rows = hit.filter("_m = _n").select("query", "id", (F.col("_tf") / F.col("n_tokens")).alias("relevance"))
        rows = rows if kept is None else rows.unionByName(kept)
        best = cut_lineage(top_n(rows.distinct(), ["query"], [F.desc("relevance"), F.asc("id")], top))
        worst = best.filter(F.col("rank") == top).select("query", F.col("relevance").alias("_worst"))
        ahead = blocks.filter(F.col("block") == last).select("token", F.col("top").alias("_next"))
        # a small margin, as the bound adds its shares in another order than the relevance
        bound = (F.col("_next") + F.col("_others")) * (1 + 1e-9)
        still = plan.filter(F.col("_blocks") > last).join(worst, "query", "left").join(ahead, "token", "left")
        plan_next = cut_lineage(still.filter(F.col("_worst").isNull() | F.col("_next").isNull() | (F.col("_worst") <= bound)).select(plan.columns))
        best = best.drop("rank")
        if plan_next.isEmpty():
            done.append(best)
            return reduce(DataFrame.unionByName, done)
        done.append(best.join(plan_next.select("query"), "query", "left_anti"))
        kept = best.join(plan_next.select("query"), "query", "left_semi")
        plan, first, last = plan_next, last, 2 * last


def search_combine(parts: list[DataFrame], targets: DataFrame) -> DataFrame:
    """(query, ensg_id, relevance, status, rank): best relevance per id, targets before interactors."""
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.groupBy("query", "ensg_id").agg(F.max("relevance").alias("relevance"))
    t = targets.select("ensg_id", F.lit("Target").alias("status")).distinct()
    return best.join(t, "ensg_id", "left").withColumn("status", F.coalesce("status", F.lit("Interactor")))


def target_names(designs: DataFrame, uniprot: DataFrame) -> DataFrame:
    """First protein name per target name."""
    from ..functions import cols as C
    j = designs.join(uniprot.select("uniprot_id", "protein_names"), "uniprot_id")
    return j.groupBy("target_name").agg(F.min_by("protein_names", "design_id").alias("_p")).select("target_name", C.protein_name("_p").alias("protein_name"))


def name_prefix(names: DataFrame, column: str, prefix: str) -> DataFrame:
    return names.filter(F.lower(column).startswith(prefix.lower()))
