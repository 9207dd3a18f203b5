"""Log-likelihood of complete documents under a gated recurrent language model with a class-factored output.

Tokens are words (runs without ASCII white space, A-Z lowered) and one end for each document. All words are counted over
all training texts. The ``HEAD`` most frequent ones and the end are symbols of the network, ``PER_CLASS`` of a frequency
band to a class; every other word belongs to one of ``TAIL`` classes by its first two bytes and whether it ends in a
mark. The network predicts the class of the next token from what came before; inside a head class it predicts the word,
inside a tail class words have their counted shares, with one more share for words never seen. So the probabilities of
all tokens, known or not, add up to at most 1. The state is carried through a document, window after window.

How it runs: tasks turn their texts into blocks of word numbers with a count for each distinct word of the block; the
counts meet by word in a shuffle (a word has a row for each block, not for each use), go back to their block, and the
block is scored with what the whole corpus says about its words.

The network learns by truncated backpropagation through time in numpy, in ``ROUNDS`` rounds. In a round every task goes
once through the round's part of its training rows, whole documents of any length, beginning with the same weights; the
weights of all tasks are then averaged by their tokens, first within groups of tasks. Together the rounds take a share
``SHARE`` of the training rows by a hash of id and text, all of them unless less is asked for, so documents and steps
grow in proportion to the corpus.

Null and empty texts are one end. Without training texts N and V are 0, no word is known and the network stays as it
starts. Repeated rows count and are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

from . import gru
from .common import blocks, documents, fold, release, sums, tidy

HEAD = 2048
PER_CLASS = 64
PAIRS = 24
TAIL = 2 * PAIRS
HIDDEN = 24
BLOCK = 8 << 20
LANES = 1024
WINDOW = 32
STATES = 1 << 14
PART = 1024
CALM = 40
SHARE = 1.0
ROUNDS = 8
TRAIN_LANES, FEW_LANES, LANE_TOKENS = 512, 64, 1024
TRAIN_TOKENS = 1 << 19
FAN_IN = 64
FOLDS, HELD = 7, 2
MARKS = b".,;:!?"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    real = np.asarray(pc.binary_length(words)) > 0  # white space at an end of a text gives an empty word
    sizes = sums(real.astype(np.int64), np.asarray(pc.list_value_length(lists), np.int64))
    return words if real.all() else words.filter(pa.array(real)), sizes


@cache
def pair_classes() -> np.ndarray:
    """Tail classes of words without a mark at their end by the first byte and the second, 256 if there is none."""
    return np.array([[zlib.crc32(bytes([a, b][: 2 - b // 256])) % PAIRS * 2 for b in range(257)] for a in range(256)], np.int32)


def tail_classes(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """Of the words numbered ``at``; ``tail_class_sql`` says the same."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    first, last = ends[at], ends[at + 1] - 1
    second = np.where(first < last, data[np.minimum(first + 1, last)].astype(np.int32), 256)
    return pair_classes()[data[first], second] + np.isin(np.arange(256), list(MARKS))[data[last]]


def tail_class_sql(word: Column) -> Column:
    ends = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int").isin(*MARKS).cast("int")
    return (F.pmod(F.crc32(F.substring(word, 1, 2)), F.lit(PAIRS)) * 2 + ends).cast("int")


# --- the network


def chosen(h: np.ndarray, w: np.ndarray, at: np.ndarray, calm: bool, n: int, grad: np.ndarray | None = None):
    """Logarithm of the share of column ``at`` in each row of ``h @ w``, softmaxed; with ``grad`` also the gradient of the
    mean loss over ``n`` rows by ``h``, and that by ``w`` is added to ``grad``.

    The last column of ``h`` is 1, for the biases. ``calm`` says that no logit can leave what exp takes.
    """
    x = h @ w
    if not calm:
        x -= x.max(1, keepdims=True)
    flat, at = x.reshape(-1), at + np.arange(len(h)) * w.shape[1]
    own = flat.take(at)
    np.exp(x, out=x)
    total = x @ np.ones(w.shape[1], x.dtype)
    if grad is None:
        return own - np.log(total), None
    flat[at] -= total
    scale = (1 / (total * n))[:, None]
    grad += (h * scale).T @ x
    return own - np.log(total), (x @ w[:-1].T) * scale


def calm(w: np.ndarray) -> np.ndarray:
    """Whether the logits of states between -1 and 1 stay within exp's range, for a matrix or each of several; the last row has the biases."""
    reach, bias = np.abs(w[..., :-1, :]).sum(-2), w[..., -1, :]
    return ((bias + reach).max(-1) < CALM) & ((bias - reach).max(-1) > -CALM)


class Network:
    """Symbols 0 (the end) to heads - 1 are words, the next ``TAIL`` ones tail classes; all can be read as input."""

    def __init__(self, counts: list[int], tail_counts: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.heads = len(counts)
        self.head_classes = -(-self.heads // PER_CLASS)
        padded = np.zeros(self.head_classes * PER_CLASS)
        padded[: self.heads] = np.asarray(counts, float) + 1
        inside = padded.reshape(self.head_classes, PER_CLASS)
        mass = np.concatenate([inside.sum(1), np.asarray(tail_counts, float) + 1])
        with np.errstate(divide="ignore"):
            d = np.maximum(np.log(inside / inside.sum(1, keepdims=True)), -1e4)
        self.w = gru.layer(self.heads + TAIL, HIDDEN, rng)
        self.w["C"] = rng.normal(0, 0.05, (HIDDEN, len(mass))).astype(np.float32)
        self.w["c"] = np.log(mass / mass.sum()).astype(np.float32)
        self.w["D"] = np.zeros((self.head_classes, HIDDEN, PER_CLASS), np.float32)
        self.w["d"] = d.astype(np.float32)

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.heads, symbols // PER_CLASS, symbols - self.heads + self.head_classes)

    def output(self, h: np.ndarray, symbols: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Log-probability of each symbol after state ``h``; with ``grads`` also the gradient of the mean loss by ``h``."""
        n, learn = len(h), grads is not None
        kind = self.class_of(symbols).astype(np.int16)
        order = np.argsort(kind, kind="stable")  # class by class, head classes first
        kind, place = kind[order], (symbols % PER_CLASS)[order]
        own = np.column_stack([h.take(order, axis=0), np.ones(n, h.dtype)])
        outer, inner = np.vstack([self.w["C"], self.w["c"]]), np.concatenate([self.w["D"], self.w["d"][:, None]], axis=1)
        g_outer, g_inner = np.zeros_like(outer), np.zeros_like(inner) if learn else inner
        log, d, even = np.empty(n, h.dtype), np.empty_like(h) if learn else None, bool(calm(outer))
        for i in range(0, n, PART):  # a part's logits stay in the cache
            at = slice(i, i + PART)
            log[at], d_own = chosen(own[at], outer, kind[at], even, n, g_outer if learn else None)
            if learn:
                d[at] = d_own
        cuts = np.searchsorted(kind, np.arange(self.head_classes + 1)).tolist()
        for k, even in enumerate(calm(inner).tolist()):
            for i in range(cuts[k], cuts[k + 1], PART):
                at = slice(i, min(i + PART, cuts[k + 1]))
                more, d_own = chosen(own[at], inner[k], place[at], even, n, g_inner[k] if learn else None)
                log[at] += more
                if learn:
                    d[at] += d_own
        out = np.empty_like(log)
        out[order] = log
        if not learn:
            return out, None
        grads |= {"C": g_outer[:-1], "c": g_outer[-1], "D": g_inner[:, :-1], "d": g_inner[:, -1]}
        d_h = np.empty_like(d)
        d_h[order] = d
        return out, d_h

    def train(self, docs: list[np.ndarray], opt: gru.Adam, lanes: int, rate: float = 1.0) -> None:
        """Truncated backpropagation, once over documents laid one after the other into lanes; the state starts anew with
        each document and each lane."""
        flat = np.concatenate(docs)
        starts = np.zeros(len(flat), bool)
        starts[np.cumsum([0, *map(len, docs[:-1])])] = True
        before = np.concatenate([[0], flat[:-1]])
        before[starts] = 0
        # many lanes cost less a token, few lanes give few tokens more steps
        lanes = max(1, min(lanes, max(min(FEW_LANES, len(flat) // WINDOW), len(flat) // LANE_TOKENS)))
        length = -(-len(flat) // lanes)
        at = np.arange(lanes)[None, :] * (len(flat) - length) // max(lanes - 1, 1)  # lanes cover all tokens
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            rows = at + np.arange(t, min(t + WINDOW, length))[:, None]
            x, anew = before[rows], starts[rows]
            states, saved = gru.forward(x, h, self.w, anew)
            grads: dict[str, np.ndarray] = {}
            _, d = self.output(states.reshape(-1, HIDDEN), flat[rows].ravel(), grads)
            grads |= gru.backward(x, d.reshape(states.shape), saved, self.w, anew)
            opt.update(grads, rate)
            h = states[-1]

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = values[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n

    def score(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of the symbols of each document; all documents are at least one symbol long."""
        out, begin = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
        before = np.concatenate([[0], flat[:-1]])
        before[begin] = 0
        order = np.argsort(-sizes, kind="stable")
        for i in range(0, len(order), LANES):
            own = order[i : i + LANES]
            h = np.zeros((len(own), HIDDEN), np.float32)
            t0, stop = 0, int(sizes[own[0]])
            while t0 < stop:
                n = int(np.searchsorted(-sizes[own], -t0))  # documents longer than t0
                steps = min(max(WINDOW, STATES // n), stop - t0)
                rows = np.minimum(begin[own[:n]][None, :] + np.arange(t0, t0 + steps)[:, None], len(flat) - 1)
                states = gru.states(before[rows], h[:n], self.w)
                h = states[-1]
                real = np.arange(t0, t0 + steps)[:, None] < sizes[own[:n]][None, :]
                log, _ = self.output(states[real], flat[rows[real]])
                out += np.bincount(np.broadcast_to(own[:n], real.shape)[real], log, len(sizes))
                t0 += steps
        return out


# --- blocks of texts and their words

ENCODED = "block long, id {}, held_out boolean, codes binary, code int, word binary, n long"


def encoder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (codes of their words in the block) and rows of words (their number of uses in training)."""
    block = (TaskContext.get().partitionId()) << 32
    for batch in blocks(batches, "text", BLOCK):
        own, sizes = tokens(batch.column("text"))
        own = own.dictionary_encode()
        words, codes = own.dictionary, np.asarray(own.indices)
        held = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        used = codes[~np.repeat(held, sizes)]
        n = np.bincount(used, minlength=len(words))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
        rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(codes.astype("<i4"))])
        none, kinds = len(rows), batch.schema.field("id").type
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(none, block)), batch.column("id"), batch.column("held_out"), rows,
             pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64())],
            ["block", "id", "held_out", "codes", "code", "word", "n"])
        for i in range(0, len(words), 50_000):
            k = min(50_000, len(words) - i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block)), pa.nulls(k, kinds), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()),
                 pa.array(np.arange(i, i + k, dtype=np.int32)), words.slice(i, k), pa.array(n[i : i + k])],
                ["block", "id", "held_out", "codes", "code", "word", "n"])
        block += 1


def scorer(net: Network, n_all: int, v_all: int, n_docs: int, tails: np.ndarray, kind: pa.DataType):
    """Scores the documents of a block; ``tails`` has the tokens and the distinct words of each tail class."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at = np.asarray(words.column("code"))
        c, symbol = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        c[at], symbol[at] = np.asarray(words.column("c")), np.asarray(words.column("symbol"))
        c[-1], symbol[-1] = n_docs, 0  # the end
        rows = [np.frombuffer(x, "<i4") for x in docs.column("codes").to_pylist()]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        flat = np.full(int(sizes.sum()), len(at), np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(sizes) - 1] = False
        if inner.any():
            flat[inner] = np.concatenate(rows)
        base = np.log10((c + 1.0) / (n_all + v_all + 1.0))
        k = np.maximum(symbol - net.heads, 0)
        share = np.where(symbol < net.heads, 0.0, np.log((c + 1.0) / (tails[0][k] + tails[1][k] + 1.0)))
        log = net.score(symbol[flat], sizes) + sums(share[flat], sizes)
        known = sums((c[flat] > 0).astype(np.int64), sizes)
        out = [docs.column("id").combine_chunks().cast(kind), docs.column("held_out").combine_chunks(), pa.array(sizes), pa.array(known),
               pa.array(sums(base[flat], sizes)), pa.array(log / np.log(10))]
        del flat, inner, rows, c, symbol
        release()
        return pa.table(out, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


WEIGHTS = "task int, tokens long, weights binary"


def symbols(texts: pa.Array, heads: dict[bytes, int], tail: int) -> list[np.ndarray]:
    """For each text the symbols of its words and the end; those of tail classes begin at ``tail``."""
    words, sizes = tokens(texts)
    found = pc.index_in(words, value_set=pa.array(list(heads), pa.binary()))
    rest = np.flatnonzero(np.asarray(found.is_null()))
    own = np.array([*heads.values(), 0], np.int32)[np.asarray(found.fill_null(len(heads)))]
    if len(rest):
        own[rest] = tail + tail_classes(words, rest)
    ends = np.cumsum(sizes + 1)
    flat = np.zeros(len(own) + len(sizes), np.int32)
    flat[np.arange(len(own)) + np.repeat(np.arange(len(sizes)), sizes)] = own
    return [flat[e - n - 1 : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def learner(net: Network, heads: dict[bytes, int], lanes: int, rate: float):
    """One pass over the rows of a task: its weights and how many tokens they saw."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opt = gru.Adam(net.w, 0.01)
        docs, waiting, seen = [], 0, 0
        for batch in blocks(batches, "text"):
            for own in symbols(batch.column("text"), heads, net.heads):
                docs.append(own)
                waiting += len(own)
                if waiting >= TRAIN_TOKENS:
                    net.train(docs, opt, lanes, rate)
                    docs, waiting, seen = [], 0, seen + waiting
        if docs:
            net.train(docs, opt, lanes, rate)
        seen += waiting
        if seen:
            own = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen]), pa.array([net.flat().tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(own, ["task", "tokens", "weights"])

    return run


def averaged(found: pa.Table) -> pa.Table:
    """The mean of weights by tokens, in the order of the tasks."""
    found = found.sort_by("task")
    n = found.column("tokens").to_pylist()
    total = 0.0
    for k, w in zip(n, found.column("weights"), strict=True):
        total = total + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * (k / sum(n))
    own = [found.column("task")[:1].combine_chunks(), pa.array([sum(n)]), pa.array([total.astype(np.float32).tobytes()], pa.binary())]
    return pa.table(own, ["task", "tokens", "weights"])


def train(rows: DataFrame, heads: dict[bytes, int], counts: list[int], tail_counts: list[int], share: float, rounds: int, lanes: int, seed: int) -> Network:
    """Fit the network to a share of all training rows; the driver sees one set of weights a round."""
    net = Network(counts, tail_counts, seed)
    part = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 20)) / F.lit((1 << 20) * share / rounds)
    rows = rows.where(~F.col("held_out")).select("text", F.floor(part).alias("round"))
    for k in range(rounds):
        own = rows.where(F.col("round") == k).select("text")
        found = own.mapInArrow(tidy(learner(net, heads, lanes, 1 - 0.9 * k / rounds)), WEIGHTS)
        found = found.groupBy(F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(averaged, WEIGHTS)
        found = found.groupBy(F.pmod("task", F.lit(1))).applyInArrow(averaged, WEIGHTS).collect()  # one row
        if found:
            net.set_flat(np.frombuffer(found[0]["weights"], np.float32))
    return net


def likelihood(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
    share: float = SHARE,
    rounds: int = ROUNDS,
    lanes: int = TRAIN_LANES,
    seed: int = 9,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    encoded = stored(rows.mapInArrow(tidy(encoder), ENCODED.format(kind)), "encoded")
    texts_, words = encoded.where("word IS NULL"), encoded.where("word IS NOT NULL").select("block", "code", "word", "n")
    counts = words.groupBy("word").agg(F.sum("n").alias("c")).select("word", "c", tail_class_sql(F.col("word")).alias("tail"))
    counts = stored(counts, "counts")
    known = counts.where("c > 0")
    top = stored(known.orderBy(F.desc("c"), "word").limit(head - 1), "heads")
    frequent = sorted(((bytes(r["word"]), r["c"], r["tail"]) for r in top.collect()), key=lambda r: (-r[1], r[0]))
    n_docs = texts_.where("NOT held_out").count()
    tails, n_all, v_all = np.zeros((2, TAIL)), n_docs, int(n_docs > 0)
    for r in known.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # TAIL rows
        tails[:, r["tail"]] += (r["c"], r["v"])
        n_all, v_all = n_all + r["c"], v_all + r["v"]
    for _, c, t in frequent:
        tails[:, t] -= (c, 1)
    heads = {w: i + 1 for i, (w, _, _) in enumerate(frequent)}
    net = train(rows, heads, [n_docs, *(c for _, c, _ in frequent)], tails[0].tolist(), share, rounds, lanes, seed)
    number = F.row_number().over(W.orderBy(F.desc("c"), "word"))  # over at most ``head`` rows
    # the most frequent words have a row in every block; they don't meet in one task
    head = F.broadcast(top.select("word", "c", number.cast("int").alias("symbol")))
    own = words.select(F.col("block").alias("of"), "code", "word")
    rest = own.join(head, "word", "left_anti").join(counts, "word").select("of", "code", "c", (F.col("tail") + len(heads) + 1).alias("symbol"))
    symbols = own.join(head, "word").select("of", "code", "c", "symbol").unionByName(rest)
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    score = scorer(net, n_all, v_all, n_docs, tails, arrow)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = texts_.select("block", "id", "held_out", "codes").groupBy("block").cogroup(symbols.groupBy("of")).applyInArrow(score, schema)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_gru_lm(spark, sf_dir: str) -> DataFrame:
    return likelihood(documents(spark, sf_dir), fold("doc_id", FOLDS) == HELD)
