"""Repeats of 50 bytes against every window in plain Python, and maximal repeats against all pairs of places."""

import random
import tracemalloc
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import frame
from tidewell.llm import repeats as R


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - 49):
            if d is not None and least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), sum(gone), sum(gone[i] > gone[i - 1] for i in range(len(b))), sha256(kept).hexdigest()))
    return Counter(out)


def got(df, **kw):
    return Counter(map(tuple, R.deduplicated(df, **kw).collect()))


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def passages(seed, n=60):
    """Texts of shared and own parts; short cycles and zeros among them, shared parts cut at random."""
    rng = random.Random(seed)
    words = ["an", "thé", "of", "日本", "\0", "ab" * 30, "x" * 90, "lorem", "ipsum", "dolor "]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            text += p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))
        rows.append((rng.choice([i, i, i // 2, None]), text, "en", "s"))
    return rows


def test_odd_rows(odd):
    assert got(odd) == brute(pairs(odd))


def test_rows_twice(odd):
    df = odd.union(odd)
    assert got(df) == brute(pairs(df))


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 3), (3, 0)])
def test_shared_passages(spark, seed, hot):
    """Also where anchors are dealt by their windows because they are in more than ``hot`` texts."""
    rows = passages(seed)
    want = brute([r[:2] for r in rows])
    assert sum(r[2] for r in want) > 1000
    assert got(frame(spark, rows).repartition(3), hot=hot) == want


def test_nothing(spark, empty):
    assert not got(empty)
    rows = [(1, None, "", ""), (2, "short", "", ""), (3, "x" * 49, "", ""), (4, "x" * 50, "", ""), (5, "x" * 51, "", "")]
    assert got(frame(spark, rows)) == brute([r[:2] for r in rows])


def test_many_copies(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(i, text + ("" if i % 3 else f" end {i}"), "", "") for i in range(120)]
    assert got(frame(spark, rows)) == brute([r[:2] for r in rows])


def test_pieces_cut_anywhere(monkeypatch):
    rng = np.random.default_rng(0)
    flat = rng.integers(97, 100, 5_000).astype(np.uint8)
    sizes = np.array([0, 700, 49, 50, 0, 3_000, 1_201, 0])

    def windows():
        text, lo, n, g = R.anchors(flat, sizes)
        return {(int(s), int(t), int(x)) for t, a, k, x in zip(text, lo, n, g, strict=True) for s in range(a, a + k)}

    whole = windows()
    assert len(whole) == sum(max(0, int(s) - 49) for s in sizes)
    monkeypatch.setattr(R, "PIECE", 333)
    assert windows() == whole


def test_groups_are_maximal_and_whole(spark):
    rows = [r for r in passages(5, 25) if r[0] is not None]
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(t.encode())
    df = frame(spark, rows)
    found = defaultdict(set)
    for r in R.repeats(df).collect():
        found[r["repeat"], r["length"]].add((r["doc_id"], r["start"]))
    covered = set()
    for (_, length), places in found.items():
        heads = {t[s : s + length] for d, s in places for t in texts[d]}
        assert length >= 50
        assert len({d for d, _ in places}) > 1
        string = next(h for h in heads if all(any(t[s : s + length] == h for t in texts[d]) for d, s in places))
        every = {(d, i) for d, ts in texts.items() for t in ts for i in range(len(t) - length + 1) if t[i : i + length] == string}
        assert places == every  # all occurrences, not only neighbours
        covered |= {string[i : i + 50] for i in range(length - 49)}
    owners = defaultdict(set)
    for d, ts in texts.items():
        for t in ts:
            for i in range(len(t) - 49):
                owners[t[i : i + 50]].add(d)
    assert covered == {w for w, ds in owners.items() if len(ds) > 1}


def test_intervals_by_hand():
    strings = sorted(b"p" * 50 + s for s in (b"aaa", b"aab", b"ab", b"b", b"b"))
    n = [len(s) for s in strings]
    shared = [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(strings, strings[1:], strict=False)]
    ids, before = np.array([4, 3, 2, 1, 5]), np.array([7, 7, 8, -1, -1])
    got = set(R.intervals(np.array(shared), ids, ids, before))
    assert got == {(0, 4, 50, 1), (0, 2, 51, 2), (3, 4, 51, 1)}  # (0, 1, 52) is preceded by one byte only
    assert n[0] == 53


def test_unstable_input_raises(spark):
    with pytest.raises(RuntimeError, match="store them first"):
        import pyarrow as pa

        R.without(pa.table({"chunk": [1], "blob": [b""]}), pa.table({"chunk": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())}))


def cell_of_copies(n):
    """All contexts of n texts, dealt to one cell: copies with a word of their own."""
    rng = random.Random(5)
    words = [f"word{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = [" ".join([*words[: i % 119], f"own{i}", *words[i % 119 :]]) for i in range(n)]
    [(name, blob, _)] = R.chunked([pa.RecordBatch.from_pydict({"id": pa.array(range(n), pa.int64()), "text": pa.array(texts)})])
    none = pa.table({"bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
    return R.contexts(1, 1)(pa.table({"chunk": [name], "blob": pa.array([blob], pa.binary())}), none)


def test_groups_come_in_bounded_portions(monkeypatch):
    """However many occurrences the groups of a cell have, a bounded number is listed at a time, and each once."""
    cell = cell_of_copies(40)

    def found():
        spans = R.spans(cell).to_pylist()
        return sorted(tuple(r.values()) for r in R.listed(cell).to_pylist()), [[x.tolist() for x in R.unpack(r["spans"])] for r in spans if r["spans"]]

    whole = found()
    monkeypatch.setattr(R, "PLACES", 100)
    sizes = [len(g[1]) for g in R.groups_of(cell)]
    assert len(sizes) > 10 and max(sizes) <= 100 + 2 * 40  # a portion ends with the suffix that fills it
    assert found() == whole


def test_memory_of_a_cell_of_copies():
    cell = cell_of_copies(3_000)
    tracemalloc.start()
    R.spans(cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
