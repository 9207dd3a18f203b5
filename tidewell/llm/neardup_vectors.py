"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Vectors of equal labels are compared. Identical vectors count as one class with a multiplicity. A table gives each class
a code of ``bits`` signs; classes with equal codes meet, and the cosine of every pair that meets is computed in double
precision. A pair that meets in several tables counts in the first. The number of bits grows with the logarithm of the
largest label, the number of tables with what a pair at the threshold needs to be missed with a probability of ``miss``
at most.

A code shared by many classes is cut into blocks of ``block`` classes, and each pair of blocks is a group of its own, so
no task holds more than two blocks of one code. Groups give counts and stars of what they connect, never pairs.

A vector that is null, empty, all zero or has null or non-finite components, or whose label or id is null, links with
nothing: no link, its own component, kept. Vectors of different lengths never link. Rows that repeat an id are one node
for reachability; each counts as a vector. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.durable import stored

from .common import documents
from .components import components

CELL_ROWS = 8192


def tables_for(largest: int, threshold: float, miss: float, per_code: int = 16) -> tuple[int, int]:
    """(bits, tables) for labels of up to ``largest`` classes."""
    bits = min(24, max(4, round(math.log2(max(1, largest) / per_code)))) if largest else 4
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def signs(bits: int, tables: int, seed: int):
    """Adds ``codes``, one number for each table, to rows with ``vec`` (double precision, binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            vecs, dims = batch.column("vec").to_pylist(), np.asarray(batch.column("dim"))
            codes = np.zeros((len(vecs), tables), np.int32)
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), bits * tables))
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(vecs[i] for i in at), "<f8").reshape(len(at), d)
                up = (x @ planes[d] > 0).reshape(len(at), tables, bits)
                codes[at] = up @ powers
            yield batch.append_column("codes", pa.array(list(codes), pa.list_(pa.int32())))

    return run


def stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(smallest id, other id) for everything that a symmetric matrix of links connects."""
    out, open_rows = [], linked.any(1)
    for i in np.argsort(ids, kind="stable"):
        if not open_rows[i]:
            continue
        inside = np.zeros(len(ids), bool)
        inside[i] = True
        front = np.array([i])
        while len(front):
            reached = linked[front].any(0) & ~inside
            inside |= reached
            front = np.flatnonzero(reached)
        open_rows &= ~inside
        out += [(int(ids[i]), int(ids[j])) for j in np.flatnonzero(inside) if j != i]
    return out


def compare(threshold: float):
    """Links inside the groups of a cell: (a, b, links) with links for a, or a star from a to b."""

    def run(cell: pa.Table) -> pa.Table:
        group = np.asarray(cell.column("grp"))
        order = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True]) + 1 if len(order) else []
        ids, n, t = (np.asarray(cell.column(c)) for c in ("id", "n", "t"))
        first, own_block = np.asarray(cell.column("bi")), np.asarray(cell.column("blk"))
        codes = np.stack(cell.column("codes").to_numpy())
        vecs = cell.column("vec").to_pylist()
        links: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        start = 0
        for end in ends:
            at, start = order[start:end], end
            if len(at) < 2:
                continue
            x = np.frombuffer(b"".join(vecs[i] for i in at), "<f8").reshape(len(at), -1)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            left = own_block[at] == first[at]
            if not left.all():
                linked &= left[:, None] != left[None, :]
            for earlier in range(t[at[0]]):
                if not linked.any():
                    break
                c = codes[at, earlier]
                linked &= c[:, None] != c[None, :]
            if not linked.any():
                continue
            count = linked @ n[at]
            for i in np.flatnonzero(count):
                links[int(ids[at[i]])] = links.get(int(ids[at[i]]), 0) + int(count[i])
            edges.update(stars(ids[at], linked))
        a = [*links, *(e[0] for e in edges)]
        b = [*([None] * len(links)), *(e[1] for e in edges)]
        k = [*links.values(), *([None] * len(edges))]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(k, pa.int64())})

    return run


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    miss: float = 1e-4,
    block: int = 512,
    seed: int = 17,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    text = F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))
    rows = rows.select("id", "label", F.when(F.col("good"), F.col("v")).alias("v"), F.when(F.col("good"), F.sha2(text, 256)).alias("digest"))
    rows = stored(rows, "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "classes")
    reps = classes.alias("c").join(rows.alias("r"), (F.col("r.id") == F.col("c.rep")) & (F.col("r.digest") == F.col("c.digest")) & (F.col("r.label") == F.col("c.label")))
    reps = reps.select("c.label", "c.rep", "c.n", "v").dropDuplicates(["label", "rep"])
    reps = reps.select("label", F.col("rep").alias("id"), "n", F.size("v").alias("dim"), "v")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, miss)
    coded = reps.mapInArrow(_binary, "label string, id long, n long, dim int, vec binary")
    coded = stored(coded.mapInArrow(signs(bits, tables, seed), "label string, id long, n long, dim int, vec binary, codes array<int>"), "coded")
    met = coded.select("*", F.posexplode("codes").alias("t", "code"))
    key = ["label", "dim", "t", "code"]
    sizes = met.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    met = met.join(sizes.where("m > 1").drop("m"), key)
    met = met.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")})
    met = met.withColumn("grp", F.xxhash64(*key, "bi", "bj"))
    n_rows = sizes.where("m > 1").agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    cells = max(64, -(-n_rows // CELL_ROWS))
    met = met.withColumn("cell", F.pmod("grp", F.lit(cells)))
    met = met.select("cell", "grp", "id", "n", "t", "bi", "blk", "codes", "vec")
    found = stored(met.groupBy("cell").applyInArrow(compare(threshold), "a long, b long, links long"), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    near = components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(links, "rep", "left").join(near.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "label", "digest").join(known, ["label", "digest"], "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _binary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of doubles as little-endian bytes."""
    for batch in batches:
        v = batch.column("v")
        flat, ends = np.asarray(v.flatten(), "<f8"), np.asarray(v.offsets) - v.offsets[0].as_py()
        vec = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield batch.drop_columns("v").append_column("vec", pa.array(vec, pa.binary()))


def op9_hyperplane_neardup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"))
