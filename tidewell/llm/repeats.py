"""Repeated byte strings of whole texts: maximal repeat groups with all their occurrences, and texts without the repeats.

Every ``SPAN`` bytes of a text choose one of their grams of ``GRAM`` bytes, the one of smallest hash (an anchor), so equal
strings of that length choose equal anchors at equal places. Texts are read in chunks of some megabytes, and work is
dealt by anchors:

1. A chunk sends four bytes for each anchor of each text to the anchor's bucket; buckets are as many as the input needs,
   so that their size stays the same. A bucket answers with a bit: does the anchor occur in two texts?
2. For those that do, the chunk sends the bytes that the windows of the anchor cover (a context), equal ones once, with
   all places, to the anchor's cell. An anchor of more than ``HOT`` texts is dealt by its windows instead.
3. A cell sorts the suffixes of its distinct contexts that are as long as ``SPAN`` (a suffix array), with the lengths
   of the prefixes that neighbours share, and finds the intervals of common prefixes by one scan with a stack. An interval
   is a repeat that can't be extended to the right; one whose occurrences are preceded by different bytes, or that begins
   its context, can't be extended to the left either and is put out with all occurrences, those in inner intervals too.
4. The spans go back to their chunk, which removes what also starts in a text of a smaller id.

A repeat longer than its context is put out as a chain of overlapping groups with the same occurrences. Contexts have
less than 2 * SPAN bytes, so an interval has at most SPAN levels inside it and the output stays in proportion.

Chunks are named by their content and read three times, so the input has to give the same rows in the same order each
time, as a scan of files does; if it doesn't, an error is raised (store it first). Ids are whole numbers.

Defined results: null and empty texts, and those shorter than ``SPAN``, keep all they have; a null id is neither smaller
nor larger than another one, so its text stays whole and removes nothing. Rows of the same id never remove each other.
Strings are bytes of UTF-8, so a removed run may begin or end inside a character. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, ragged, release, texts, tidy

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1  # grams of a window; also the most windows that share an anchor
WIDEST = 80  # bytes of the longest context, SPAN + REACH - 1
CHUNK, PIECE = 8 << 20, 1 << 19
PER_BUCKET, PER_CELL, HOT, BATCH = 1 << 20, 1 << 21, 50_000, 1 << 13
PLACES = 1 << 19  # occurrences of groups that a cell lists at once
NONE = np.iinfo(np.int64).max
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
PLACE = np.uint64((1 << 24) - 1)


def pack(*values) -> bytes:
    raw = pickle.dumps(values, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def folded(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    for c in range(words.shape[1]):
        x = (x ^ words[:, c]) * ODD[0]
        x ^= x >> np.uint64(29)
    x *= ODD[1]
    return x ^ (x >> np.uint64(32))


def slices(key: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of each run of equal keys."""
    if not len(key):
        return []
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True))


# --- chunks and anchors


def chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, tuple]]:
    """(name, packed form, (ids, lengths, bytes)) of chunks of texts."""
    for batch in blocks(batches, "text", CHUNK):
        own = texts(batch.column("text"))
        ids = np.asarray(batch.column("id").fill_null(NONE), np.int64)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        content = (ids, sizes, b"".join(own))
        blob = pack(*content)
        yield int.from_bytes(blake2b(blob, digest_size=8).digest(), "little", signed=True), blob, content


def minima(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its smallest one (the first of equal ones)."""
    b = flat.astype(np.uint64)
    two = b[:-1] | (b[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    n = len(b) - GRAM + 1
    h = eight[:n] * ODD[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n]
    h *= ODD[1]
    h ^= h >> np.uint64(32)
    h += four[16 : 16 + n]
    h *= ODD[2]
    h ^= h >> np.uint64(31)
    least, width = (h & ~PLACE) | np.arange(n, dtype=np.uint64), 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    last = n - REACH + 1
    least = np.minimum(least[:last], least[REACH - width :][:last])
    return h, (least & PLACE).astype(np.int64)


def anchors(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, hash) of each run of windows with one anchor."""
    ends, out = np.cumsum(sizes), []
    for a in range(0, len(flat) - SPAN + 1, PIECE):
        h, at = minima(flat[a : a + PIECE + SPAN - 1])
        start = np.arange(a, a + len(at))
        first = int(np.searchsorted(ends, a, side="right"))
        upto = int(np.searchsorted(ends, a + len(at) - 1, side="right")) + 1
        lengths = np.diff(np.concatenate([[a], np.minimum(ends[first:upto], a + len(at))]))
        text = np.repeat(np.arange(first, upto), lengths)
        own = start + SPAN <= ends[text]
        start, at, text = start[own], at[own], text[own]
        if len(start):
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
            begin = np.flatnonzero(new)
            g = h[at[begin]] * ODD[0]
            out.append((text[begin], start[begin], np.diff(np.append(begin, len(start))), g ^ (g >> np.uint64(33))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def entries(text: np.ndarray, g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of each text once, by bucket: (hash, bucket, entry of each anchor)."""
    order = np.lexsort((text, g, g % np.uint64(buckets)))
    g_, t_ = g[order], text[order]
    new = np.concatenate([np.ones(min(1, len(g)), bool), (g_[1:] != g_[:-1]) | (t_[1:] != t_[:-1])])
    entry = np.empty(len(g), np.int64)
    entry[order] = np.cumsum(new) - 1
    once = g_[new]
    return once, (once % np.uint64(buckets)).astype(np.int64), entry


def prints(buckets: int):
    """Rows (chunk, bucket, print): four bytes for each anchor of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, (_, sizes, raw) in chunked(batches):
            text, _, _, g = anchors(np.frombuffer(raw, np.uint8), sizes)
            once, bucket, _ = entries(text, g, buckets)
            marks, cuts = (once >> np.uint64(32)).astype("<u4"), slices(bucket)
            rows = [marks[i:j].tobytes() for i, j in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array([int(bucket[i]) for i, _ in cuts], pa.int64()), pa.array(rows, pa.binary())], ["chunk", "bucket", "print"])

    return tidy(run)


def repeated(hot: int):
    """For each row of a bucket two bits an anchor: does it occur in two texts, and in more than ``hot``?"""
    return lambda table: _repeated(table, hot)


def _repeated(table: pa.Table, hot: int) -> pa.Table:
    rows = [np.frombuffer(x, "<u4") for x in table.column("print").to_pylist()]
    every = np.concatenate(rows)
    _, inverse, n = np.unique(every, return_inverse=True, return_counts=True)
    n, at, bits = n[inverse], 0, []
    for r in rows:
        own = n[at : at + len(r)]
        bits.append(np.packbits(np.stack([own > 1, own > hot])).tobytes())
        at += len(r)
    release()
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])


# --- contexts


def cut_out(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of each context as a row of ``WIDEST`` bytes, zeros behind its end."""
    padded = np.concatenate([flat, np.zeros(WIDEST, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[begin]
    rows[np.arange(WIDEST) >= size[:, None]] = 0
    return rows


def distinct(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct context, number of the distinct context of each row)."""
    h = folded(rows.view("<u8"), size.astype(np.uint64))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    other = (rows != rows[first[number]]).any(1) | (size != size[first[number]])  # equal hashes of different bytes
    lone = np.flatnonzero(other)
    number[lone] = len(first) + np.arange(len(lone))
    return np.concatenate([first, lone]), number


def contexts(buckets: int, cells: int):
    """Rows (cell, chunk, contexts) of a chunk; one row without contexts tells that the chunk was here."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if chunks.num_rows:
            name = chunks.column("chunk")[0].as_py()
            out.append((name % cells, name, b""))
            ids, sizes, raw = unpack(chunks.column("blob")[0].as_py())
            flat = np.frombuffer(raw, np.uint8)
            text, lo, n, g = anchors(flat, sizes)
            once, bucket, entry = entries(text, g, buckets)
            twice, hot = np.ones(len(once), bool), np.zeros(len(once), bool)  # without an answer all are sent
            ends = {int(bucket[i]): (i, j) for i, j in slices(bucket)}
            for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
                i, j = ends[b]
                twice[i:j], hot[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (j - i)).reshape(2, -1)
            keep, split = twice[entry], (twice & hot)[entry]
            keep &= ~split
            at = ragged(lo[split], n[split])
            begin = np.concatenate([lo[keep], at])
            size = np.concatenate([n[keep], np.ones(len(at), np.int64)]) + SPAN - 1
            text = np.concatenate([text[keep], np.repeat(text[split], n[split])])
            key = g[keep]
            if len(at):  # windows of hot anchors are dealt by their own bytes
                whole = cut_out(flat, at, np.full(len(at), SPAN))
                key = np.concatenate([key, folded(whole.view("<u8"), np.full(len(at), SPAN, np.uint64))])
            if len(begin):
                out += dealt(name, flat, begin, size, text, key, ids, sizes, cells)
        release()
        cell, chunk, blob = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(cell, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["cell", "chunk", "contexts"])

    return run


def dealt(name, flat, begin, size, text, key, ids, sizes, cells) -> Iterator[tuple[int, int, bytes]]:
    first, number = distinct(cut_out(flat, begin, size), size)
    cell = (key[first] % np.uint64(cells)).astype(np.int64)
    by_cell = np.argsort(cell, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_cell] = np.arange(len(first))
    order = np.argsort(rank[number], kind="stable")
    places = np.bincount(rank[number], minlength=len(first))
    upto = np.cumsum(places)
    text, start = text[order], (begin - (np.cumsum(sizes) - sizes)[text])[order]
    for i, j in slices(cell[by_cell]):
        own = first[by_cell[i:j]]
        a, b = int(upto[i] - places[i]), int(upto[j - 1])
        raw = flat[ragged(begin[own], size[own])].tobytes()
        row = pack((key[own] >> np.uint64(32)).astype(np.uint32), size[own].astype(np.uint8), raw, places[i:j].astype(np.int32), text[a:b].astype(np.int32), start[a:b].astype(np.int32), ids[text[a:b]])
        yield int(cell[by_cell[i]]), name, row


# --- the suffix array of a cell


def suffixes(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``SPAN`` bytes in order: (context, start in it, length, bytes shared with the one before)."""
    n = size - SPAN + 1
    context, start = np.repeat(np.arange(len(size)), n), ragged(np.zeros(len(size), np.int64), n)
    wide = np.zeros((len(rows), 2 * WIDEST), np.uint8)
    wide[:, :WIDEST] = rows
    own = np.lib.stride_tricks.sliding_window_view(np.append(wide.ravel(), np.zeros(1, np.uint8)), WIDEST)[context * (2 * WIDEST) + start]
    length = size[context] - start
    words = own.view(">u8")
    order = np.lexsort((length, *(words[:, c].astype(np.uint64) for c in range(words.shape[1] - 1, -1, -1))))
    own, length = own[order], length[order]
    other = own[1:] != own[:-1]
    shared = np.where(other.any(1), other.argmax(1), WIDEST)
    shared = np.minimum(shared, np.minimum(length[1:], length[:-1]))
    return context[order], start[order], length, np.concatenate([[0], shared])


def intervals(shared: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, length, smallest id) of the common-prefix intervals of at least ``SPAN`` bytes that several bytes
    precede and that two ids share; ``left`` is the byte before a suffix, -1 at the beginning of its context.
    """
    out, stack = [], []  # of [length, first, smallest id, largest id, byte before or -1]
    inside = np.flatnonzero((shared >= SPAN) | np.append(shared[1:] >= SPAN, False))
    following = np.append(np.where(np.diff(inside) == 1, shared[inside[1:]], 0), 0) if len(inside) else inside
    of = zip(inside.tolist(), following.tolist(), low[inside].tolist(), high[inside].tolist(), left[inside].tolist(), strict=True)
    for i, depth, lo, hi, before in of:
        first = i
        while stack and stack[-1][0] > depth:
            length, first, lo_, hi_, before_ = stack.pop()
            lo, hi = min(lo, lo_), max(hi, hi_)
            before = before if before == before_ else -1
            if before < 0 and lo < hi:
                out.append((first, i, length, lo))
        if depth < SPAN:
            continue
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2], top[3] = min(top[2], lo), max(top[3], hi)
            top[4] = top[4] if top[4] == before else -1
        else:
            stack.append([depth, first, lo, hi, before])
    return out


def union(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes covered by spans; spans that touch are one run."""
    order = np.lexsort((start, text))
    text, start, end = text[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    upto = np.maximum.accumulate((text << 32) + end)
    new = np.concatenate([np.ones(min(1, len(text)), bool), ((text << 32) + start)[1:] > upto[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1 if len(at) else at
    return text[at], start[at], upto[last] & ((1 << 32) - 1)


def portions(first: np.ndarray, end: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, first suffix, one past the last) of groups or parts of them, about ``PLACES`` occurrences at a time.

    ``upto`` has the number of occurrences of all suffixes before each one.
    """
    parts = np.maximum(1, -(-(upto[end] - upto[first]) // PLACES))
    group = np.repeat(np.arange(len(first)), parts)
    begin = np.searchsorted(upto, upto[first][group] + ragged(np.zeros(len(first), np.int64), parts) * PLACES)
    stop = np.append(begin[1:], 0)
    stop[np.cumsum(parts) - 1] = end
    size = upto[stop] - upto[begin]
    for i, j in slices((np.cumsum(size) - size) // PLACES):
        yield group[i:j], begin[i:j], stop[i:j]


def groups_of(table: pa.Table) -> Iterator[tuple]:
    """For each portion of a batch of a cell: (groups as (first, last, length, smallest id), what their suffixes are, contexts, places)."""
    rows = [(c, unpack(b)) for c, b in zip(table.column("chunk").to_pylist(), table.column("contexts").to_pylist(), strict=True) if b]
    if not rows:
        return
    mark = np.concatenate([r[0] for _, r in rows])
    size = np.concatenate([r[1] for _, r in rows]).astype(np.int64)
    flat = np.frombuffer(b"".join(r[2] for _, r in rows), np.uint8)
    places = np.concatenate([r[3] for _, r in rows]).astype(np.int64)
    text, start, ids = (np.concatenate([r[k] for _, r in rows]) for k in (4, 5, 6))
    chunk = np.repeat(np.array([c for c, _ in rows], np.int64), [len(r[4]) for _, r in rows])
    del rows
    begin, upto = np.cumsum(size) - size, np.cumsum(places)
    order = np.argsort(mark, kind="stable")
    i = 0
    while i < len(order):
        j = min(i + BATCH, len(order))
        while j < len(order) and mark[order[j]] == mark[order[j - 1]]:  # contexts of an anchor stay together
            j = i + int(np.searchsorted(mark[order[i:]], mark[order[j - 1]], side="right"))
        own = order[i:j]
        i = j
        found = cut_out(flat, begin[own], size[own])
        first, number = distinct(found, size[own])
        found, length = found[first], size[own][first]
        at = ragged(upto[own] - places[own], places[own])
        of = np.repeat(number, places[own])
        by = np.argsort(of, kind="stable")
        at, n = at[by], np.bincount(of, minlength=len(first))
        heads = np.cumsum(n) - n
        low, high = np.minimum.reduceat(ids[at], heads), np.maximum.reduceat(ids[at], heads)
        context, offset, tail, shared = suffixes(found, length)
        before = np.where(offset > 0, found[context, np.maximum(offset - 1, 0)].astype(np.int64), -1)
        whole = np.flatnonzero((offset == 0) & (low < high)[context])  # equal contexts are intervals of their own
        same = zip(whole.tolist(), whole.tolist(), tail[whole].tolist(), low[context[whole]].tolist(), strict=True)
        nodes = np.array([*intervals(shared, low[context], high[context], before), *same], np.int64).reshape(-1, 4)
        occurrences = np.concatenate([[0], np.cumsum(n[context])])
        for group, a, b in portions(nodes[:, 0], nodes[:, 1] + 1, occurrences):
            covered = ragged(a, b - a)
            c = context[covered]
            place = at[ragged(heads[c], n[c])]
            node, shift = np.repeat(np.repeat(group - group[0], b - a), n[c]), np.repeat(offset[covered], n[c])
            yield nodes[group[0] : group[-1] + 1], node, found, context, offset, chunk[place], text[place], start[place] + shift, ids[place]


def spans(table: pa.Table) -> pa.Table:
    """Rows (chunk, spans): what texts lose because it also starts in a text of a smaller id."""
    out = [(c, b"") for c, b in zip(table.column("chunk").to_pylist(), table.column("contexts").to_pylist(), strict=True) if not b]
    names = np.unique(np.asarray(table.column("chunk")))
    runs = []
    for nodes, node, _, _, _, chunk, text, start, ids in groups_of(table):
        later = (ids > nodes[node, 3]) & (ids != NONE)
        if later.any():
            chunk, text, start, end = chunk[later], text[later].astype(np.int64), start[later], (start + nodes[node, 2])[later]
            wide = int(text.max()) + 1
            key, start, end = union(np.searchsorted(names, chunk) * wide + text, start, end)
            runs.append([x.astype(np.int32) for x in (key // wide, key % wide, start, end)])
    chunk, text, start, end = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int32),) * 4
    order = np.argsort(chunk, kind="stable")
    for i, j in slices(chunk[order]):
        own = order[i:j]
        out.append((int(names[chunk[own[0]]]), pack(*(x.astype(np.int32) for x in union(text[own], start[own], end[own])))))
    del runs
    release()
    chunk, blob = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["chunk", "spans"])


def listed(table: pa.Table) -> pa.Table:
    """Rows (repeat, length, id, start): all occurrences of all groups of a cell."""
    out = []
    for nodes, node, found, context, offset, _, _, start, ids in groups_of(table):
        heads = [(found[context[a], offset[a] : offset[a] + n]).tobytes() for a, _, n, _ in nodes.tolist()]
        names = np.array([int.from_bytes(blake2b(h, digest_size=8).digest(), "little", signed=True) for h in heads], np.int64)
        out.append(pa.table([pa.array(names[node]), pa.array(nodes[node, 2]), pa.array(ids, mask=ids == NONE), pa.array(start.astype(np.int64))], ["repeat", "length", "id", "start"]))
    release()
    none = pa.table([pa.array([], pa.int64())] * 4, ["repeat", "length", "id", "start"])
    return pa.concat_tables([none, *out])


def without(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """(id, n_bytes, n_removed, n_spans, kept) of the texts of a chunk."""
    if not chunks.num_rows or not found.num_rows:
        raise RuntimeError("the texts were not read twice in the same order; store them first")
    out = []
    marks = [unpack(b) for b in found.column("spans").to_pylist() if b]
    runs = union(*(np.concatenate([m[k] for m in marks]) for k in range(3))) if marks else (np.zeros(0, np.int64),) * 3
    for blob in chunks.column("blob").to_pylist():
        ids, sizes, raw = unpack(blob)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(runs[0], np.arange(len(sizes) + 1))
        gone = np.bincount(runs[0], runs[2] - runs[1], len(sizes)).astype(np.int64)
        kept = []
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            at, digest = a, sha256()
            for s, e in zip(runs[1][cuts[k] : cuts[k + 1]].tolist(), runs[2][cuts[k] : cuts[k + 1]].tolist(), strict=True):
                digest.update(raw[at : a + s])
                at = a + e
            digest.update(raw[at:b])
            kept.append(digest.hexdigest())
        out.append(pa.table([pa.array(ids, mask=ids == NONE), pa.array(sizes), pa.array(gone), pa.array(np.diff(cuts)), pa.array(kept, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]))
    release()
    return pa.concat_tables(out)


def _celled(docs: DataFrame, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """Chunks by name, and their contexts by cell."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    grams = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (REACH + 1)  # one number
    buckets, cells = 1 + grams // PER_BUCKET, 1 + grams // PER_CELL

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, blob, _ in chunked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], ["chunk", "blob"])

    chunks = rows.mapInArrow(tidy(whole), "chunk long, blob binary")
    answers = rows.mapInArrow(prints(buckets), "chunk long, bucket long, print binary").groupBy("bucket").applyInArrow(repeated(hot), "chunk long, bucket long, bits binary")
    sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(contexts(buckets, cells), "cell long, chunk long, contexts binary")
    return chunks, sent.groupBy("cell")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(repeat, length, id, start): the occurrences of every maximal repeat of ``SPAN`` bytes or more that two ids share.

    Null is an id of its own here.
    """
    _, cells = _celled(docs, id_col, text_col, hot)
    return cells.applyInArrow(listed, "repeat long, length long, id long, start long").withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    chunks, cells = _celled(docs, id_col, text_col, hot)
    found = cells.applyInArrow(spans, "chunk long, spans binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(without, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))


OP12_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * SPAN}) AS w FROM (SELECT *, unnest(range(n - {SPAN - 1})) AS i FROM b)),
gone AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY w) AS least FROM w) WHERE least < doc_id),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {SPAN} THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
runs AS (SELECT r, k, min(i) AS a, max(i) + {SPAN} AS e FROM numbered GROUP BY r, k),
kept AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
texts AS (
  SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS rest
  FROM kept JOIN b USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM b LEFT JOIN texts USING (r)
"""
