"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target number of words. Its whole copies are certain; the remaining fraction p is the share of the
source's words that one more copy of some documents must give. A document's inclusion odds for that copy are p / (1 - p)
times its size over the mean size of its source's documents with words, so a longer document is likelier to be taken, at
a probability below one. The documents of a source are ranked by their random odds u / (1 - u) over their inclusion odds,
and the sample is the start of that ranking whose size is nearest to the words still missing: a sample of fixed size with
unequal probabilities.

The ranking is never sorted as a whole: documents fall into buckets of the rank, bucket totals give each source's
boundary bucket, and only the documents of boundary buckets are sorted. One source may hold most rows.

Defined cases: null text has size 0; null is a source of its own, last in order; sources of size 0 have target 0; ties of
the rank go to the smaller id, then size; of repeated rows at the boundary some get one copy more than others; a null id
draws as the empty string; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def word_count(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, documents (those with words) and target, one row a source.

    Sources in order of code points (null last) have the weights in turn and share `share` times all words by weight.
    No target exceeds `most` times its source; what is cut off is shared by weight among the others until none is
    above. The result of that repetition is reached at once: sources are ordered by the level at which they are full,
    and the level of the others follows from the words and weights that the full ones leave.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("documents"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighted = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", most * F.col("source_size"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = weighted.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * common)
    return levels.select("source", "source_size", "documents", target.alias("target"))


def draw(id_col: str | Column, seed: str) -> Column:
    """A number in (0, 1) that follows from the id: reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """id, source, size, source_size, target and taken of every document; taken is a whole multiple of size."""
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = stored(
        source_targets(sizes, weights, share, most)
        .withColumn("copies", F.floor(share_of))
        .withColumn("p", share_of - F.col("copies"))
        .withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumnRenamed("source", "of"),
        "targets",
    )
    u = draw("id", seed)
    mean = F.col("source_size") / F.col("documents")
    odds = (u / (1 - u)) / F.when((F.col("p") > 0) & (F.col("size") > 0), (F.col("p") / (1 - F.col("p"))) * (F.col("size") / mean))
    ranked = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rank", odds)
    ranked = ranked.withColumn("bucket", F.floor(BUCKETS * (F.col("rank") / (1 + F.col("rank")))))
    totals = ranked.where("p > 0").groupBy("of", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("of").orderBy("bucket")
    edges = (
        totals.withColumn("upto", F.sum("words").over(upto))
        .join(targets.select(F.col("of").alias("of_"), F.col("missing")), F.col("of").eqNullSafe(F.col("of_")))
        .where("upto > missing")
        .groupBy("of")
        .agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("below"))
        .withColumnRenamed("of", "edge_of")
    )
    # a source without an edge bucket is taken as a whole
    placed = ranked.join(stored(edges, "edges"), F.col("of").eqNullSafe(F.col("edge_of")), "left")
    outside = placed.where("edge is null or bucket is null or bucket <> edge").withColumn("more", ((F.col("p") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("int"))
    inside = placed.where("bucket = edge")
    until = F.col("below") + F.sum("size").over(Window.partitionBy("of").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("more", (2 * until - F.col("size") <= 2 * F.col("missing")).cast("int"))
    both = outside.unionByName(inside)
    taken = (F.col("size") * (F.col("copies") + F.coalesce(F.col("more"), F.lit(0)))).cast("long")
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS documents, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, documents, CASE WHEN cap / weight <= level THEN cap
             ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM t),
c AS (SELECT *, floor(r) AS copies, r - floor(r) AS p, target - floor(r) * source_size AS missing FROM p),
u AS (SELECT d.doc_id, d.size, c.*, (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / ((p / (1 - p)) * (size::DOUBLE / (source_size::DOUBLE / documents::DOUBLE))) END AS rank FROM u),
b AS (SELECT *, floor(4096 * (rank / (1 + rank))) AS bucket FROM q),
w AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket, rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN p > 0 AND 2 * upto - size <= 2 * missing THEN 1 ELSE 0 END))::BIGINT AS taken FROM w
"""
