"""Small series and plain Python restatements to compare with."""

from __future__ import annotations

import datetime as dt
import random

SCHEMA = "ts_id string, id string, ts timestamp_ntz, value double"
START = dt.datetime(2023, 3, 30, 5)
HOUR = 3600
DAY = 86400


def at(i: int, res: int = HOUR) -> dt.datetime:
    return START + dt.timedelta(seconds=i * res)


def frame(spark, series: dict, res: int = HOUR):
    """``{(ts_id, id): [values]}`` on a regular grid; None is a missing value."""
    rows = [(k[0], k[1], at(i, res), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, res: int = HOUR, column: str = "value") -> dict:
    """Back to ``{(ts_id, id): [values]}``; the rows must be a grid from START."""
    out: dict = {}
    for r in df.collect():
        out.setdefault((r["ts_id"], r["id"]), {})[int((r["ts"] - START).total_seconds()) // res] = r[column]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def masked(n: int, seed: int, gap: float = 0.4, burst: int = 5) -> list:
    """Random values with gaps of random length, also at both ends."""
    rnd = random.Random(seed)
    out: list = []
    while len(out) < n:
        if rnd.random() < gap:
            out += [None] * rnd.randint(1, burst)
        else:
            out += [round(rnd.uniform(1, 100), 2) for _ in range(rnd.randint(1, burst))]
    return out[:n]


def close(a, b, tol: float = 1e-8) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def same(got: dict, want: dict, tol: float = 1e-8) -> None:
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k]), k
        for i, (a, b) in enumerate(zip(got[k], want[k])):
            assert close(a, b, tol), (k, i, a, b)


def runs(vs: list, missing: bool) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of missing or known values."""
    out, i = [], 0
    while i < len(vs):
        j = i
        while j + 1 < len(vs) and (vs[j + 1] is None) == (vs[i] is None):
            j += 1
        if (vs[i] is None) == missing:
            out.append((i, j))
        i = j + 1
    return out
