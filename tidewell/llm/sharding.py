"""Uniform shuffle into shards of exact sizes by a communication matrix.

Rows lie in parts. How many rows each part sends to each shard is drawn first, from the distribution that these counts
have under a uniform permutation of all rows (multivariate hypergeometric, part by part, given what the parts before
have used of each shard). Then every part permutes its own rows and sends the first ones to the first shard, the next
ones to the second and so on, and every shard permutes what it received. Sizes are exact by construction.

Only the number of rows of each part reaches the driver: a row for every ``part_rows`` rows of input. Inside a shard the
second permutation orders random keys cell by cell, so no task holds a whole shard.

A null text counts as empty and has the checksum of the empty text. Repeated rows and ids are dealt row by row. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

LEAST_PARTS = 64


def hypergeometric(good: int, bad: int, n: int, rng: random.Random) -> int:
    """How many of ``n`` draws without replacement are good, by inversion outwards from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_choose(a: int, b: int) -> float:
        return lg(a + 1) - lg(b + 1) - lg(a - b + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - top
    down = up = top
    i = j = mode
    while u > 0 and (i > low or j < high):
        if j < high:
            up *= (good - j) / (j + 1) * (n - j) / (bad - n + j + 1)
            j += 1
            u -= up
            if u <= 0:
                return j
        if i > low:
            down *= i / (good - i + 1) * (bad - n + i) / (n - i + 1)
            i -= 1
            u -= down
            if u <= 0:
                return i
        if up + down < 1e-300:
            break
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of ``parts`` sent to each of ``shards``; both margins are met exactly."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for n in parts:
        row, rest = [], sum(left)
        for free in left:
            x = hypergeometric(free, rest - free, n, rng)
            row.append(x)
            rest -= free
            n -= x
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _lookup(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small table from parameters, without leaving the JVM."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")
    return spark.range(1).select(F.inline(text))


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 40,
    seed: int = 11,
    part_rows: int = 50_000,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shard sizes differ by one row at most, slots count from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()).alias("draw"),
    )
    rows = stored(rows, "shard_rows")
    n = rows.count()
    n_parts = max(LEAST_PARTS, -(-n // part_rows))
    rows = rows.withColumn("part", F.pmod("draw", F.lit(n_parts)).cast("int"))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in names], sizes, seed)
    sent = []
    for p, row in zip(names, matrix, strict=True):
        ends, total = [], 0
        for x in row:
            total += x
            ends.append(total)
        sent.append({"to_part": p, "ends": ends})
    # the first permutation and what each part sends
    key = F.xxhash64(F.lit(seed + 1), "draw")
    place = F.row_number().over(W.partitionBy("part").orderBy(key, "draw"))
    rows = rows.withColumn("place", place)
    table = _lookup(spark, sent, "to_part: int, ends: array<bigint>")
    rows = rows.join(table, rows["part"] == table["to_part"])
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    # the exchange and the second permutation
    bits = max(1, math.ceil(math.log2(max(1, n / n_shards / part_rows))))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed + 2), "draw", "place"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    rows = rows.select("id", "size", "text_crc32", "shard", "cell", "key", "draw")
    cells = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "draw"))
    rows = rows.withColumn("inside", inside).join(cells, ["shard", "cell"])
    return rows.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot")
    )


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
