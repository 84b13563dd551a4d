"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ten words (a shorter item is one window). Containment of a whole window needs all its
words, so its necessary prefix is one word: the rarest in the corpus. Documents meet windows on that word; the position
of the word in the window bounds where the window may start (not before the text, not past its end), the second rarest
word must stand at its place, and what is left is compared word for word.

Defined cases: a null text or item has no words and no windows; items with equal windows each count; repeated documents
give one row each; null ids are rows of their own, null item ids are left out; an empty benchmark leaves every document
clean; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import stored, table

WORD = r"[a-z0-9A-Z\x80-\x{10FFFF}]+"  # the letters that are met most come first: the class is tested in this order
WINDOW = 10
SMALL = 32 << 20  # bytes of a benchmark's windows, as measured, up to which they are broadcast; beyond, words are shuffled


def lower_ascii(text: str | Column) -> Column:
    """A-Z in lower case, all else as it is."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(lower_ascii(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item_id, window (array of words), and wid, the same for equal windows."""
    worded = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).withColumn("wid", F.md5(F.concat_ws(" ", "window").cast("binary")))


def anchored(windows: DataFrame, docs: DataFrame, hint) -> DataFrame:
    """Distinct windows all of whose words the corpus has, each with its rarest and second rarest word and their places.

    The words of the benchmark are counted over all documents.
    """
    distinct = windows.select("wid", "window").dropDuplicates(["wid"])
    placed = distinct.select("wid", "window", F.posexplode("window").alias("at", "word"))
    vocabulary = stored(placed.select("word").distinct(), "vocabulary")
    seen = docs.select(F.explode("words").alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    by_rarity = F.sort_array(F.collect_list(F.struct("n", "word", "at")))  # of the words of one window
    ranked = placed.join(seen, "word").groupBy("wid").agg(F.first("window").alias("window"), by_rarity.alias("r")).where(F.size("r") == F.size("window"))
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    return ranked.select("wid", "window", F.size("window").alias("len"), F.col("r")[0]["word"].alias("rarest"), F.col("r")[0]["at"].alias("rarest_at"), second["word"].alias("next"), second["at"].alias("next_at"))


def find_windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, mark, start, len and wid of every occurrence of a window; docs has id, mark and words. The anchors are sent to
    all tasks, so every document is searched where it is."""
    start = F.col("at") - F.col("rarest_at")
    near = (start >= 0) & (start + F.col("len") <= F.size("words")) & (F.get("words", start + F.col("next_at")) == F.col("next"))
    met = docs.select("id", "mark", "words", F.posexplode("words").alias("at", "word")).join(F.broadcast(anchors), (F.col("word") == F.col("rarest")) & near)
    return met.where(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("window")).select("id", "mark", start.alias("start"), "len", "wid")


def find_windows_shuffled(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same for anchors of any number. Words travel to their anchors one by one, each with the word that follows (the
    two make most chance meetings part), and only documents that have met one bring their text to the comparison."""
    end = F.size("words")
    words = docs.select("id", "mark", end.alias("n"), F.posexplode(F.transform("words", lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("words", i + 1)).alias("after")))).alias("at", "w"))
    placed = words.select("id", "mark", "n", "at", "w.word", "w.after")
    start = F.col("at") - F.col("rarest_at")
    follows = F.when(F.col("rarest_at") + 1 < F.col("len"), F.xxhash64(F.get("window", F.col("rarest_at") + 1)))
    keys = anchors.select("wid", "len", "rarest", "rarest_at", follows.alias("follows"))
    met = placed.join(keys, (F.col("word") == F.col("rarest")) & (start >= 0) & (start + F.col("len") <= F.col("n")) & (F.col("follows").isNull() | (F.col("follows") == F.col("after"))))
    spots = met.select("id", "mark", start.alias("start"), "len", "wid").distinct()
    texts = docs.select(F.col("id").alias("own"), F.col("mark").alias("own_mark"), "words").dropDuplicates(["own", "own_mark"])
    found = spots.join(texts, (F.col("mark") == F.col("own_mark")) & F.col("id").eqNullSafe(F.col("own"))).select("id", "mark", "start", "len", "wid", F.slice("words", F.col("start") + 1, F.col("len")).alias("here"))
    return found.join(anchors.select("wid", "window"), "wid").where(F.col("here") == F.col("window")).select("id", "mark", "start", "len", "wid")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per document: id, mark (a hash of the text), n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    windows = stored(item_windows(items, item_col, item_text_col, window), "windows")
    weight = windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 64)).first()[0] or 0
    small = weight <= SMALL
    hint = F.broadcast if small else (lambda df: df)
    # equal rows are alike in all respects: id and a hash of the text are key enough
    worded = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words_of(text_col).alias("words"))
    anchors = stored(anchored(windows, worded, hint), "anchors")
    spans = (find_windows if small else find_windows_shuffled)(worded, anchors).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("wid").alias("wids"))
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["reach"], x["start"]))).alias("hit"),
            F.greatest(a["reach"], x["start"] + x["len"]).alias("reach"),
        ),
    )["hit"]
    hits = spans.select("id", "mark", "wids", covered.alias("n_hit"))
    of = hint(windows.select("wid", "item_id").distinct())
    found = hits.select("id", "mark", "n_hit", F.explode("wids").alias("wid")).join(of, "wid").groupBy("id", "mark").agg(F.first("n_hit").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = found.select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "n_hit", "item_ids")
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")  # in any case
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), n_words.alias("n_words"))
    joined = base.join(found, (F.col("mark") == F.col("hit_mark")) & F.col("id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return joined.select(F.col("id").alias(id_col), "mark", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0),
n AS (SELECT item_id, w[a:a + 9] AS window_words, len(w[a:a + 9]) AS n FROM s),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS a FROM d),
m AS (SELECT p.doc_id, p.a, n.n, n.item_id FROM p JOIN n ON p.w[p.a] = n.window_words[1] WHERE p.w[p.a:p.a + n.n - 1] = n.window_words),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS x FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
