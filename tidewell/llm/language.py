"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every byte with probabilities of the languages, and a
document's probabilities are the mean over all its bytes. A window is one word with a space before and after it, or
``WINDOW`` bytes of a longer word. Windows don't depend on their neighbours, so a task runs the network once for each
distinct word that it has met and adds the sums up for each document; the result is that of reading every byte.

Training: windows of a bounded sample of labelled documents (``per_lang`` documents of each language, by hash of the id),
backpropagation through time in numpy on the driver, cross entropy at every byte.

Null texts and texts without a letter give ``und`` with score 0, as does every text when there is nothing to learn from;
empty texts have no letter. Rows with null languages are predicted but not learned from. Repeated rows are predicted one
by one. Other columns are ignored. Equal probabilities: the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import gru
from .common import LEXICON_WORDS, Lexicon, blocks, documents, fold, release, schema, sums, text_of, texts, texts_for, tidy, with_rows

WINDOW = 24
HIDDEN = 16
FOLDS = 5
LEAST_SCORE = 0.3


def windows(word: bytes) -> list[bytes]:
    if len(word) <= WINDOW:
        return [b" " + word + b" "]
    return [b" " + word[i : i + WINDOW] + b" " for i in range(0, len(word), WINDOW)]


def by_length(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the same length as (positions in the list, bytes by step and lane)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes):
        where = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, side="right")]
        for i in range(0, len(where), 2048):
            own = where[i : i + 2048]
            flat = np.frombuffer(b"".join(parts[j] for j in own), np.uint8)
            yield own, np.ascontiguousarray(flat.reshape(len(own), n).T)


class ByteNetwork:
    """Weights of both directions and of the labels; ``langs`` are the learned values in order."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.w = {f"f{k}": v for k, v in gru.layer(256, hidden, rng).items()}
        self.w |= {f"r{k}": v for k, v in gru.layer(256, hidden, rng).items()}
        self.w["V"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.w["c"] = np.zeros(len(langs), np.float32)
        self.hidden = hidden

    def side(self, name: str) -> dict[str, np.ndarray]:
        return {k: self.w[name + k] for k in ("W", "U", "b")}

    def train(self, parts: list[bytes], labels: np.ndarray, steps: int, lanes: int, seed: int = 1) -> None:
        rng, opt = np.random.default_rng(seed), gru.Adam(self.w, 0.01)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        groups = [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
        share = np.array([len(g) * sizes[g[0]] for g in groups], float)
        share /= share.sum()
        for i in range(steps):
            g = groups[rng.choice(len(groups), p=share)]
            own = g[rng.integers(0, len(g), lanes)]
            x = np.frombuffer(b"".join(parts[j] for j in own), np.uint8).reshape(lanes, -1).T
            y = labels[own]
            zero = np.zeros((lanes, self.hidden), np.float32)
            f, r = self.side("f"), self.side("r")
            hf, sf = gru.forward(x, zero, f)
            hr, sr = gru.forward(x[::-1], zero, r)
            both = np.concatenate([hf, hr[::-1]], axis=2)
            d = both @ self.w["V"] + self.w["c"]
            d = np.exp(d - d.max(-1, keepdims=True))
            d /= d.sum(-1, keepdims=True)
            d[:, np.arange(lanes), y] -= 1
            d /= d.shape[0] * lanes
            flat = d.reshape(-1, d.shape[-1])
            back = d @ self.w["V"].T
            grads = {f"f{k}": v for k, v in gru.backward(x, back[:, :, : self.hidden], sf, f).items()}
            grads |= {f"r{k}": v for k, v in gru.backward(x[::-1], back[::-1, :, self.hidden :], sr, r).items()}
            grads["V"] = both.reshape(-1, both.shape[-1]).T @ flat
            grads["c"] = flat.sum(0)
            opt.update(grads, 1 - 0.9 * i / steps)

    def label(self, x: np.ndarray) -> np.ndarray:
        """Sums over the steps of the probabilities of each byte, for each lane."""
        f, r, k = self.side("f"), self.side("r"), self.hidden
        states = np.empty((*x.shape, 2 * k), np.float32)
        for p, at, steps in ((f, slice(0, k), range(len(x))), (r, slice(k, 2 * k), range(len(x) - 1, -1, -1))):
            h = np.zeros((x.shape[1], k), np.float32)
            for t in steps:
                h = gru.step(p["W"][x[t]], h, p)
                states[t, :, at] = h
        d = states.reshape(-1, 2 * k) @ self.w["V"]
        d += self.w["c"]
        d -= d.max(-1, keepdims=True)
        np.exp(d, out=d)
        d /= d.sum(-1, keepdims=True)
        return d.reshape(*x.shape, -1).sum(0)


def word_sums(net: ByteNetwork, words: list[bytes]) -> np.ndarray:
    """For each word the sums of its bytes' probabilities and, last, the number of bytes."""
    out = np.zeros((len(words), len(net.langs) + 1))
    parts, owner = [], []
    for i, w in enumerate(words):
        own = windows(w)
        parts += own
        owner += [i] * len(own)
    owner = np.asarray(owner, np.int64)
    for where, x in by_length(parts):
        np.add.at(out[:, :-1], owner[where], net.label(x))
        np.add.at(out[:, -1], owner[where], len(x))
    return out


def predictor(net: ByteNetwork, id_col: str, text_col: str):
    names = np.array([*net.langs, "und"], dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = Lexicon(), np.zeros((0, len(net.langs) + 1))
        for batch in blocks(batches, text_col):
            if len(lexicon) > LEXICON_WORDS:
                lexicon, table = Lexicon(), table[:0]
            codes, sizes = lexicon.codes(t.split() for t in texts(text_of(batch, text_col)))
            new = lexicon.since(len(table))
            if new:
                table = np.concatenate([table, word_sums(net, new)])
            total = sums(table[codes], sizes)
            mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
            best = mean.argmax(1)
            score = np.clip(mean[np.arange(len(mean)), best], 0.0, 1.0)
            letters = np.asarray(batch.column("has_letter").fill_null(False).to_numpy(zero_copy_only=False), bool)
            out = [batch.column(id_col), batch.column("held_out"), pa.array(names[np.where(letters, best, -1)], pa.string()),
                   pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays(out, [id_col, "held_out", "lang_pred", "score"])

    return tidy(run)


def sample_per_value(rows: DataFrame, id_col: str, value_col: str, n: int, seed: int) -> DataFrame:
    """Ids and values of about ``n`` rows of each value, those of the smallest hashes; values are few, as languages are."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    w = W.partitionBy(value_col).orderBy("key", id_col)
    rows = rows.select(F.col(id_col), F.col(value_col), key.alias("key"))
    counts = rows.groupBy(value_col).agg(F.count(F.lit(1)).alias("n"))
    few = rows.join(F.broadcast(counts), value_col).where(F.pmod("key", F.lit(1 << 20)) * F.col("n") <= F.lit(2 * n + 20) * F.lit(1 << 20))
    few = few.withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)
    return few.select(id_col, value_col)


def train(
    docs: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 200,
    longest: int = 20_000,
    windows_used: int = 60_000,
    steps: int = 500,
    lanes: int = 192,
    seed: int = 5,
) -> ByteNetwork | None:
    """Fit the network to a sample: ``per_lang`` documents of each language with at most ``longest`` bytes of text.

    Only the training sample has such bounds.
    """
    rows = docs.where(learn).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= longest))
    ids = sample_per_value(rows, "id", "lang", per_lang, seed).withColumnsRenamed({"id": "sample_id", "lang": "sample_lang"})
    same = F.col("id").eqNullSafe(F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))
    sample = rows.join(F.broadcast(ids.distinct()), same).groupBy("id", "lang").agg(F.min("text").alias("text"))  # a text an id
    sample = sample.select("lang", "text").collect()  # bounded by per_lang
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    rng = np.random.default_rng(seed)
    parts, labels = [], []
    for k, lang in enumerate(langs):
        own = [w for r in sorted(r["text"] for r in sample if r["lang"] == lang) for x in r.encode().split() for w in windows(x)]
        take = rng.permutation(len(own))[: windows_used // len(langs)]
        parts += [own[i] for i in take]
        labels += [k] * len(take)
    net = ByteNetwork(langs, seed=seed)
    net.train(parts, np.asarray(labels), steps, lanes)
    del parts, labels, sample
    release()
    return net


def identify(
    docs: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_id: str | None = None,
    **training,
) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row; ``learn`` says which rows may be learned from.

    ``sample_id`` is the id by which the training sample is drawn, where ``id_col`` is something else to hand on.
    """
    net = train(docs, learn, id_col=sample_id or id_col, text_col=text_col, lang_col=lang_col, **training)
    rows = docs.select(
        F.col(id_col).alias("id"), (~learn).alias("held_out"), F.col(text_col).rlike(r"\p{L}").alias("has_letter"),
        *texts_for(docs, id_col, text_col),
    )
    if net is None:
        out = rows.select("id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        kinds = schema(docs.schema[id_col].dataType, held_out="boolean", lang_pred="string", score="double")
        out = rows.mapInArrow(predictor(net, "id", text_col if sample_id else "text"), kinds)
    return out.withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, learn: Column, *, least: float = LEAST_SCORE, **options) -> DataFrame:
    """The rows of ``docs`` that have letters and whose language gets a score of at least ``least``."""
    out = identify(with_rows(docs), learn, id_col="__row", sample_id=options.pop("id_col", "doc_id"), **options)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("__row.*")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fold("doc_id", FOLDS) != 0)
