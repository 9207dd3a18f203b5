"""The dataset manifest against a tree built node by node in plain Python."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tidewell.llm.common import fold
from tidewell.llm.merkle import LOWER, UPPER, manifest

COLUMNS = ("doc_id", "source", "lang", "text")


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """All levels, and the way of each leaf as (own place, run)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    ways = []
    for at in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            way.append((at % 8, level[at - at % 8 : at - at % 8 + 8]))
            at //= 8
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    groups = {}
    for doc_id, text, lang, source in rows:
        own = leaf_of((doc_id, source, lang, text))
        copy = own
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 0 and text is not None:
            copy = leaf_of((doc_id, source, lang, text.translate(str.maketrans(UPPER, LOWER))))
        groups.setdefault(lang, []).append((doc_id, own, copy))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([r[1] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (doc_id, own, copy), way in zip(groups[g], trees[g][1], strict=True):
            proof, now = [], copy
            for at, run in [*way, *top]:
                proof += run[:at] + run[at + 1 :]
                now = h([*run[:at], now, *run[at + 1 :]])
            out.append((doc_id, own, trees[g][0], root, h(proof), now, now == root))
    return Counter(out)


def got(df):
    rows = manifest(df, COLUMNS, fold("doc_id", 3) == 0, {"text": F.translate("text", UPPER, LOWER)})
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in rows.collect())


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_odd_rows(spark, odd):
    assert got(odd) == brute(rows_of(odd))


def test_repeated_rows_and_two_texts_of_an_id(spark):
    rows = [(i // 3, f"Text {i % 2}", "x", "s") for i in range(60)] + [(5, None, None, None)] * 9 + [(1, "A", "é", "s"), (2, "b", "z", None)]
    assert got(frame(spark, rows)) == brute(rows)


def test_empty(empty):
    assert not got(empty)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_one_group_of_few_rows(spark, n):
    rows = [(i, f"T{i}", "x", None) for i in range(n)]
    assert got(frame(spark, rows)) == brute(rows)


def test_several_superblocks(spark):
    rows = [(i, f"Row {i}", "x" if i % 50 else f"lang{i % 17}", "s") for i in range(9_000)]
    rows += [(12, "Row 12", "x", "s")] * 4_200  # a run of equal rows longer than a superblock
    assert got(frame(spark, rows)) == brute(rows)
