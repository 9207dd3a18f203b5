"""Spelling variants against all pairs of words compared in plain Python."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tests.llm.conftest import frame
from tidewell.llm.merkle import LOWER, UPPER
from tidewell.llm.variants import links, spelled, variants


def cuts(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in cuts(max(a, b, key=len))


def brute(words):
    out = {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        out[w] = [form, n, len(others), -best[0] if form else None]
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def counted(rows, rarest):
    c = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= rarest}


def vocabulary(n, seed, letters="abé", longest=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}
    return {w: rng.choice([1, 2, 3, 5, 8, 40]) for w in words}


@pytest.mark.parametrize("meetings", [0, 2, 128])
def test_links_of_crowded_words(spark, meetings):
    words = vocabulary(400, meetings)
    got = [(r["a"], r["b"]) for r in links(spark.createDataFrame(list(words.items()), "word string, n long"), meetings).collect()]
    assert Counter(tuple(sorted(p)) for p in got) == Counter(tuple(sorted(p)) for p in combinations(words, 2) if near(*p))


def test_forms_roots_and_ties(spark):
    words = vocabulary(150, 7, "ab", 8) | {"ccccc": 1, "ccccd": 2, "cccdd": 4, "ccddd": 8, "cdddd": 16, "ccccx": 2}
    got = variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(words)


def test_words_of_texts(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    rows += [(i, f"Größe größe GRÖSSE ÀÉÎõü Straßen{'x' * (i % 3)} ×÷×÷×", "", "") for i in range(300)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows[odd.count() :]], "doc_id long, text string"))
    got = {r["word"]: r["n"] for r in spelled(df, rarest=2).collect()}
    assert got == counted(rows, 2)
    assert len(got) > 10


def test_empty(spark, empty):
    assert variants(spelled(empty)).collect() == []
    assert variants(spelled(frame(spark, [(1, None, None, None), (2, "", None, None)]))).collect() == []
