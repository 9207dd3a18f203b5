"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share of all words by weight, at most ``limit`` times what it has, with
the excess shared again by weight. Each document is first allocated the whole copies that are certain; the rest of the
target is a sample of unequal probabilities without replacement: documents are ranked by the odds of a random number
divided by the odds of their inclusion (Pareto sampling), and the ranking is cut where its words come nearest to the rest
of the target.

No source is ranked in one task: ranks are cut into a fixed number of cells, the words of each cell are summed, and only
rows of one cell are ordered together.

Null or empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Repeated rows
are ranked one by one; equal rows are interchangeable, so results don't depend on their order. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size).

    The sources filled up to their limit are those with the smallest limit per weight, so one ordering of the sources
    finds the level at which the others stop. The table of sources is ordered in one task: a row for each source.
    """
    s = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.min("size").alias("least")
    )
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    )
    s = s.withColumn("cap", F.col("source_size") * limit).withColumn("key", F.col("cap") / F.col("weight"))
    by = W.orderBy("key", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("among", F.sum("weight").over(after))
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("among")
    level = F.min(F.when(fits, F.struct("key", F.col("source").isNull().alias("no"), "source", "left", "among"))).over(every)
    s = s.withColumn("level", level)
    share = F.col("level.left") * F.col("weight") / F.col("level.among")
    return s.select("source", "n_docs", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def uniform(seed: int, key: Column) -> Column:
    """A number between 0 and 1 from a key; any engine with MD5 can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    seed: int = 7,
    cells: int = CELLS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: its size, source, target and the copies that the mix takes.

    Columns: the id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (words, repeats counted) and
    those of ``keep`` under ``kept_<name>``. The probability of inclusion rises with the size of a document and
    stays below proportionality: size / (size + mean size), scaled so that the expected words are the target.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
    )
    base = stored(base, "mix_sizes")
    plan = targets(base.select("source", "size"), weights, limit)
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("ratio")).withColumn("part", F.col("ratio") - F.col("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("mean", F.greatest(F.lit(1), F.floor(F.col("source_size") / F.col("n_docs"))))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    d = base.alias("a").join(plan.alias("b"), same).select("a.*", *(f"b.{c}" for c in plan.columns if c != "source"))
    pull = F.col("size") / (F.col("size") + F.col("mean"))
    # whole numbers, so that the order of summation doesn't show
    scale = d.groupBy("source").agg(F.sum(F.floor(F.col("size") * pull * 1000)).alias("pulled"))
    d = d.alias("a").join(scale.alias("b"), same).select("a.*", "b.pulled")
    p = F.least(F.lit(1.0), F.col("part") * pull * F.col("source_size") * 1000 / F.col("pulled"))
    d = d.withColumn("p", F.when((F.col("size") > 0) & (F.col("part") > 0), p))
    u = uniform(seed, F.col("id"))
    d = d.withColumn("rank", (u / (1 - u)) * ((1 - F.col("p")) / F.col("p")))
    d = d.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * cells)).cast("int"))
    sums = d.where("cell IS NOT NULL").groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    upto = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0))).drop("cell_size")
    both = same & F.col("a.cell").eqNullSafe(F.col("b.cell"))
    d = d.alias("a").join(sums.alias("b"), both, "left").select("a.*", "b.before")
    inside = W.partitionBy("source", "cell").orderBy("rank", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    mid = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    extra = F.when(F.col("cell").isNotNull() & (mid <= F.col("rest")), 1).otherwise(0)
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("int"))
    return d.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *(f"kept_{c}" for c in keep),
    )


def op7_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
             (sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS among,
             row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS i FROM s),
v AS (SELECT rest, among FROM l WHERE rest * w <= 3 * source_size * among ORDER BY i LIMIT 1),
t AS (SELECT l.source, l.source_size, n, least((3 * l.source_size)::DOUBLE, (v.rest * w)::DOUBLE / v.among) AS target FROM l, v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
x AS (SELECT d.doc_id, d.source, size, source_size, target, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS part,
             target - floor(ratio)::BIGINT * source_size AS rest, greatest(1, source_size // n) AS mean
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, size / (size + mean)::DOUBLE AS pull, (sum(floor(size * (size / (size + mean)::DOUBLE) * 1000)) OVER (PARTITION BY source))::BIGINT AS pulled,
             (('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM x),
p AS (SELECT *, CASE WHEN size > 0 AND part > 0 THEN least(1.0::DOUBLE, part * pull * source_size * 1000 / pulled) END AS p FROM y),
q AS (SELECT *, (u / (1 - u)) * ((1 - p) / p) AS rank FROM p),
c AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid FROM q)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN (whole + CASE WHEN rank IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END) * size ELSE 0 END)::BIGINT AS taken
FROM c
"""
