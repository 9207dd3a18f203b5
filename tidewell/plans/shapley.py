"""Exact Shapley values of tree ensembles and linear models against one background row.

A coalition gives its features their own values and the others those of the background. A leaf is reached by a coalition
exactly if it holds all features whose own value alone agrees with the leaf's path (p of them) and none of those whose
background value alone does (q of them); features that agree either way don't matter, one that agrees neither way makes the
leaf unreachable. Its Shapley values are therefore a closed form in p and q: value * (p - 1)! q! / (p + q)! for the former and
-value * p! (q - 1)! / (p + q)! for the latter. So one pass over the leaves gives the values of all features for a whole batch of
rows, without permutations or masked copies, and the cost grows with the leaves' path lengths, not with 2 to the features.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"^(\s*)(?:Tree \d+ \(weight (?P<weight>[-\d.eE]+)\)|(?P<side>If|Else) \(feature (?P<feature>\d+) (?P<op><=|>) (?P<at>[-\d.eE]+)\)|Predict: (?P<value>[-\d.eE]+))")


@dataclass(frozen=True)
class Leaf:
    """What a path asks of its features, low < x <= high, and its share of the ensemble's prediction."""

    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    value: float


def leaf(limits: dict[int, tuple[float, float]], value: float) -> Leaf:
    at = sorted(limits)
    return Leaf(tuple(at), tuple(limits[f][0] for f in at), tuple(limits[f][1] for f in at), value)


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted Spark forest, boosted ensemble or tree, from its printed form.

    A forest averages its trees, a boosted ensemble adds them up by weight.
    """
    text = model.toDebugString
    count, boosted = text.count("(weight ") or 1, "GBT" in text.split("\n", 1)[0]
    out: list[Leaf] = []
    path: list[tuple[int, int, str, float]] = []  # (indent, feature, comparison, threshold)
    share = 1.0
    for line in text.splitlines()[1:]:
        m = LINE.match(line)
        if m is None:
            continue
        indent = len(m.group(1))
        if m.group("weight"):
            share, path = (float(m.group("weight")) if boosted else 1.0 / count), []
        elif m.group("side"):
            path = [p for p in path if p[0] < indent]
            path.append((indent, int(m.group("feature")), m.group("op"), float(m.group("at"))))
        else:
            limits: dict[int, tuple[float, float]] = {}
            for _, f, op, at in (p for p in path if p[0] < indent):
                low, high = limits.get(f, (-np.inf, np.inf))
                limits[f] = (low, min(high, at)) if op == "<=" else (max(low, at), high)
            out.append(leaf(limits, share * float(m.group("value"))))
    return out


def weights(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For p features of the own row and q of the background: the share of one of the former, of one of the latter."""
    plus, minus = np.zeros((longest + 1, longest + 1)), np.zeros((longest + 1, longest + 1))
    for p in range(longest + 1):
        for q in range(longest + 1 - p):
            if p:
                plus[p, q] = factorial(p - 1) * factorial(q) / factorial(p + q)
            if q:
                minus[p, q] = -factorial(p) * factorial(q - 1) / factorial(p + q)
    return plus, minus


def values(x: np.ndarray, base: np.ndarray, of: list[Leaf]) -> np.ndarray:
    """Shapley values (rows, features); a NaN in ``base`` marks a feature that keeps its own value in every coalition."""
    plus, minus = weights(max((len(t.features) for t in of), default=0))
    out, fixed = np.zeros_like(x), np.isnan(base)
    for t in of:
        at = np.array(t.features, np.int64)
        if not len(at):
            continue
        low, high, own = np.array(t.low), np.array(t.high), x[:, at]
        mine = (own > low) & (own <= high)
        theirs = np.broadcast_to((base[at] > low) & (base[at] <= high), mine.shape)
        theirs = np.where(fixed[at], mine, theirs)
        reached = (mine | theirs).all(1)
        only_mine, only_theirs = mine & ~theirs, theirs & ~mine
        p, q = only_mine.sum(1), only_theirs.sum(1)
        share = only_mine * plus[p, q][:, None] + only_theirs * minus[p, q][:, None]
        out[:, at] += t.value * share * reached[:, None]
    return out


def attribute_exact(model, rows: DataFrame, inputs: list[str], base: dict[str, float]) -> DataFrame:
    """(row_key, feature, attribution): exact values of all features in ``base``; others keep their own values.

    ``rows`` hold a unique ``row_key`` and the inputs. ``model`` is a list of :class:`Leaf`, or something with ``.weights``
    (linear) or a fitted Spark tree model in ``.model``. Rows with a missing input get NULL attributions.
    """
    names = [c for c in inputs if c in base]
    linear = getattr(model, "weights", None)
    if linear is not None:
        part = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(linear.get(c, 0.0))) * (F.col(c) - F.lit(float(base[c])))).alias("attribution")) for c in names])
        return rows.select("row_key", F.explode(part).alias("_p")).select("row_key", "_p.*")
    of = model if isinstance(model, list) else leaves(model.model)
    ground = np.array([float(base[c]) if c in base else np.nan for c in inputs])
    shown = [i for i, c in enumerate(inputs) if c in base]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(inputs))
            got = values(x, ground, of)[:, shown]
            got[np.isnan(x).any(1)] = np.nan
            keys = batch.column("row_key").take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            flat = got.ravel()
            yield pa.RecordBatch.from_arrays([keys, pa.array(names * batch.num_rows, pa.string()), pa.array(flat, mask=np.isnan(flat))], ["row_key", "feature", "attribution"])

    vectors = rows.select("row_key", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in inputs]).alias("x"))
    return vectors.mapInArrow(run, f"row_key {rows.schema['row_key'].dataType.simpleString()}, feature string, attribution double")
