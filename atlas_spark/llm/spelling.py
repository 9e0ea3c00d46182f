"""Spelling variants of a corpus vocabulary: words at edit distance one, found in tries of letter-group counts.

A word is arranged by its length and then by how many of its letters fall into each letter group.  One
changed letter adds one to a group at most (surplus) and takes one from a group at most (deficit); one
inserted letter adds one to one group.  A depth-first walk down the trie spends that budget and the words of
the leaves that it reaches are verified.

The top levels of the trie are the key by which Spark deals the words: every word is stored once, under its own
key, and asks the few keys that its budget can reach.  A key with many words is cut into blocks of bounded
size, so that a task holds one block at a time however common a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199

#: Letters fall into groups by their code point modulo GROUPS.
GROUPS = 32
#: Common letters, whose groups come first; the others follow by number.
FIRST = "entirasoldcuhm"
_ORDER = [ord(c) % GROUPS for c in FIRST]
_ORDER += [g for g in range(GROUPS) if g not in _ORDER]
_LEVEL = {g: level for level, g in enumerate(_ORDER)}

#: Words of a block (held as a trie) and words that ask one block in one cell; words under one trie node before it branches; parts of a key
#: in the join with its sizes.
BLOCK = 4096
ASKING = 16384
LEAF = 8
SALTS = 32
#: Words that a key of the top levels should hold, roughly; deeper keys only change how the work is dealt.
PER_KEY = 16000
MAX_ROUNDS = 60

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, slip: int = SLIP) -> DataFrame:
    """(word): a row per run of letters of ``docs(doc_id, text)`` with ``min_length`` code points or more.

    Only A-Z is lower-cased.  Of runs whose CRC-32 of "doc_id:run" is a multiple of ``slip`` one code point is taken out
    (the CRC modulo the length gives its place), which plants slips of the pen; ``slip=0`` plants none.
    A NULL text has no runs; a NULL doc_id counts as an empty string in the CRC.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    if not slip:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod(h, F.lit(slip)) == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more over all documents."""
    return occurrences(docs, **how).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def counts_of(word: str) -> list[int]:
    """Letters of each group, in the order of the levels."""
    v = [0] * GROUPS
    for c in word:
        v[_LEVEL[ord(c) % GROUPS]] += 1
    return v


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    extra = len(b) - len(a)
    if extra > 1 or a == b:
        return False
    half = len(a) // 2
    if a[:half] == b[:half]:
        i = half
        while i < len(a) and a[i] == b[i]:
            i += 1
        return a[i + 1 - extra:] == b[i + 1:]
    if a[half:] != b[half + extra:]:
        return False
    i = 0
    while a[i] == b[i]:
        i += 1
    return a[i + 1 - extra:half] == b[i + 1:half + extra]


Word = tuple[str, int, list[int]]


def build(words: list[Word], level: int) -> list[Word] | dict:
    """Trie of (word, n, counts) from ``level`` on: a node is a dict by the count of its level's group, or a leaf of words."""
    if len(words) <= LEAF or level == GROUPS:
        return words
    below: dict[int, list[Word]] = {}
    for w in words:
        below.setdefault(w[2][level], []).append(w)
    return {c: build(ws, level + 1) for c, ws in below.items()}


def reached(node: list[Word] | dict, level: int, counts: list[int], surplus: int, deficit: int) -> Iterator[Word]:
    """Words of the leaves that the budget reaches, depth first."""
    while isinstance(node, dict):
        own = counts[level]
        level += 1
        if surplus and own + 1 in node:
            yield from reached(node[own + 1], level, counts, surplus - 1, deficit)
        if deficit and own - 1 in node:
            yield from reached(node[own - 1], level, counts, surplus, deficit - 1)
        if own not in node:
            return
        node = node[own]
    yield from node


def _asked(length: int, top: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Keys that may hold a word made from one of this key, each pair of words from one side only: words of one more letter,
    and words of the same length whose first changed level has a surplus (or no changed level among the top ones)."""
    for longer in (0, 1):
        yield length + longer, top
        for i in range(len(top)):
            up = top[:i] + [top[i] + 1] + top[i + 1:]
            yield length + longer, up
            if not longer:
                for j in range(i + 1, len(top)):
                    if top[j]:
                        yield length, up[:j] + [up[j] - 1] + up[j + 1:]


def _key(length: int, top: list[int]) -> str:
    return ",".join(map(str, (length, *top)))


def _dealt(words: DataFrame, depth: int) -> DataFrame:
    """(key, side, word, n): each word as stored (side 0) under its own key and as asking (side 1) the keys within its budget."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 5000):
                part = batch.slice(first, 5000)
                out: list[tuple] = []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    top = counts_of(word)[:depth]
                    out.append((_key(len(word), top), 0, word, n))
                    out += [(_key(*k), 1, word, n) for k in _asked(len(word), top)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                                 ["key", "side", "word", "n"])
    return words.select("word", "n").mapInArrow(run, "key string, side int, word string, n bigint")


def _into_cells(dealt: DataFrame) -> DataFrame:
    """(cell, key, side, word, n): blocks of the stored words of a key against portions of the words that ask it.

    Every stored word is in one cell per portion and every asking word in one cell per block; keys that nobody asks or that
    hold nothing go."""
    size = dealt.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("held"), F.count_if(F.col("side") == 1).alias("asking"))
    size = size.filter("held > 0 and asking > 0").select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"),
                                                          F.ceil(F.col("asking") / ASKING).cast("int").alias("portions"))
    # a common key is joined in SALTS parts, its one row of sizes is repeated for each
    salted = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = dealt.withColumn("salt", F.pmod(F.xxhash64("word", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("word"), "blocks")).otherwise(F.pmod(F.xxhash64("word"), "portions")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("portions")).otherwise(F.col("blocks")) - 1))
    d = d.select("key", "side", "word", "n", own.alias("own"), other.alias("other"))
    block, portion = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")) for s in (0, 1))
    return d.select(F.concat_ws("/", "key", block.cast("string"), portion.cast("string")).alias("cell"), "key", "side", "word", "n")


def near_words(words: DataFrame, depth: int | None = None) -> DataFrame:
    """(word, near, near_n): both directions of every two words of ``words(word, n)`` at edit distance one.

    ``depth`` is the number of levels below the length that make up a key; by default it follows the number of words.
    """
    if depth is None:
        depth, total = 1, words.count()
        while depth < len(FIRST) and total > PER_KEY * 3 ** depth:
            depth += 1
    dealt = _dealt(words, depth)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _into_cells(dealt).repartition(parts, "cell").sortWithinPartitions("cell", "side")

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, stored, trie, memo = None, [], None, {}
        length, top = 0, []
        out: list[tuple] = []
        for batch in batches:
            for c, key, side, word, n in zip(*(batch.column(k).to_pylist() for k in ("cell", "key", "side", "word", "n"))):
                if c != cell:
                    cell, stored, trie, memo = c, [], None, {}
                    length, *top = map(int, key.split(","))
                counts = counts_of(word)
                if side == 0:
                    stored.append((word, n, counts))
                    continue
                if trie is None:
                    trie = build(stored, depth)
                longer = length - len(word)
                surplus = 1 - sum(t > c for t, c in zip(top, counts))
                deficit = 0 if longer else 1 - sum(t < c for t, c in zip(top, counts))
                inside = not longer and surplus and deficit  # this key is the word's own: of two words the lesser asks
                letters = tuple(counts)
                if letters not in memo:
                    memo[letters] = list(reached(trie, depth, counts, surplus, deficit))
                for near, near_n, _ in memo[letters]:
                    if not (inside and near <= word) and one_edit(word, near):
                        out.append((word, near, near_n))
                        out.append((near, word, n))
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        yield batch_of(out)
    return cells.mapInArrow(run, "word string, near string, near_n bigint")


def forms(words: DataFrame, ratio: int = RATIO, near: Callable[[DataFrame], DataFrame] = near_words) -> DataFrame:
    """words(word, n) with n_near, form and form_n: the near word of largest n (of equal ones the least), if n is ``ratio`` times the word's."""
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    j = words.join(best, "word", "left")
    large = -F.col("best.minus") >= ratio * F.col("n")
    return j.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                    F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed(word, form, ...)`` with root: the last word when forms are followed; a word without a form is its own root.

    The way halves each round, which is checkpointed; n grows from word to form, so there are no circles.
    """
    step = cut_lineage(formed.filter("form is not null").select("word", F.col("form").alias("to")))
    for _ in range(MAX_ROUNDS):
        further = cut_lineage(step.join(step.select(F.col("word").alias("to"), F.col("to").alias("beyond")), "to", "left").select("word", "to", "beyond"))
        if further.filter("beyond is not null").isEmpty():
            break
        step = further.select("word", F.coalesce("beyond", "to").alias("to"))
    else:
        raise RuntimeError(f"forms not settled after {MAX_ROUNDS} rounds")
    return formed.join(step.select("word", F.col("to").alias("_root")), "word", "left").withColumn("root", F.coalesce("_root", "word")).drop("_root")


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, depth: int | None = None, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the vocabulary of ``docs(doc_id, text)``; other columns are not read.

    NULL and empty texts hold no words, repeated rows count each time, an empty table has no rows.  Words of any length are
    taken whole.  Near words differ by exactly one inserted, deleted or replaced code point.
    """
    words = cut_lineage(vocabulary(docs, min_count, **how))
    formed = cut_lineage(forms(words, ratio, lambda w: near_words(w, depth)))
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
