"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled texts are drawn from all texts, whatever their label, so that
toxic texts hide among them as often as the class prior says. A linear model over the distinct words of a text and their beginnings is trained on the risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)),

whose second part estimates the risk over clean texts and may not fall below zero: where a batch makes it negative, the
step goes against that part instead. At the end the bias is placed between clean and toxic
scores of rows kept apart for it. The class prior is the share of toxic texts among the labelled ones (``prior``
sets it when only toxic texts are labelled).

Training uses a bounded sample (``positives`` and ``unlabelled`` rows by hash of the id; of texts above ``longest`` bytes a
share of the words, by their hash) and runs in numpy in one task; scoring reads every whole text. A word's weight is found once for each distinct
word of a task. A word's features are the word and its first 2 to 8 letters.

Null and empty texts have no features and get the score of the bias. With fewer than two confirmed toxic texts the score
is the prior, 0.49 at most. Labels that are null say nothing; a document that any label calls toxic is toxic. Repeated rows are scored one by
one. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LEXICON_WORDS, Lexicon, blocks, documents, fold, hashed_sample, in_task, ragged, schema, sums, text_of, texts, texts_for, tidy, with_rows

FOLDS = 5
EDGES = b".,;:!?\"'()[]{}|*#$%&<>/\\-_"
STARTS = range(2, 9)
TINY = 1e-9
CAUTION = 1.6


def features(word: bytes) -> list[str]:
    """The bare word and its beginnings, lower-cased."""
    w = word.decode("utf-8", "replace").lower().strip(EDGES.decode())
    return [f"={w}", *(w[:n] for n in STARTS if n < len(w))] if w else []


class Table:
    """Texts of the sample as rows of weighted features; rare and very common features are left out.

    A feature found in n of N texts weighs log(N / n). Rows have length 1.
    """

    def __init__(self, rows: list[bytes], positive: np.ndarray, least: int, most: float):
        number, columns, sizes = Lexicon(), [], []
        seen: dict[bytes, list[int]] = {}
        for text in rows:
            own: list[int] = []
            for w in set(text.split()):
                if w not in seen:
                    seen[w] = [number[f] for f in features(w)]
                own += seen[w]
            columns.append(np.asarray(own, np.int32))
            sizes.append(len(own))
        sizes = np.asarray(sizes, np.int64)
        flat, columns = np.concatenate(columns), [np.unique(c) for c in columns]
        found = np.bincount(np.concatenate(columns), minlength=len(number))
        usual = np.bincount(np.concatenate([np.zeros(0, np.int32), *(c for c, p in zip(columns, positive, strict=True) if not p)]), minlength=len(number))
        del seen, columns
        fits = (found >= least) & (usual <= most * (~positive).sum())
        self.names = [f for f, ok in zip(number, fits, strict=True) if ok]
        self.weight = np.log(len(rows) / found[fits]) if len(self.names) else np.zeros(0)
        keep = fits[flat]
        self.column = (np.cumsum(fits) - 1).astype(np.int32)[flat[keep]]
        self.sizes = sums(keep.astype(np.int64), sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        norm = np.sqrt(np.maximum(sums(self.weight[self.column] ** 2, self.sizes), TINY))
        self.value = (self.weight[self.column] / np.repeat(norm, self.sizes)).astype(np.float32)

    def scores(self, w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of rows with ``w``, and where their entries lie."""
        at = ragged(self.starts[rows], self.sizes[rows])
        return sums(w[self.column[at]] * self.value[at], self.sizes[rows]), at


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(table: Table, positive: np.ndarray, prior: float, *, steps: int, lanes: int, rate: float, decay: float, seed: int):
    """Weights and bias by stochastic descent on the corrected risk, with shrinkage towards 0."""
    rng = np.random.default_rng(seed)
    w, speed = np.zeros(len(table.names)), np.zeros(len(table.names))
    bias, bias_speed = float(np.log(prior / (1 - prior))), 0.0
    apart = np.arange(len(positive)) % 5 == 0  # a fifth of the rows only places the bias
    pos, unl = np.flatnonzero(positive & ~apart), np.flatnonzero(~positive & ~apart)
    n_pos, n_unl = min(lanes, len(pos)), min(3 * lanes, len(unl))
    is_pos = np.arange(n_pos + n_unl) < n_pos
    for i in range(steps):
        rows = np.concatenate([rng.choice(pos, n_pos, replace=False), rng.choice(unl, n_unl, replace=False)])
        x, at = table.scores(w, rows)
        x += bias
        p, risk_0 = logistic(x), np.logaddexp(0, x)  # the risk of calling a text clean
        clean = risk_0[~is_pos].mean() - prior * risk_0[is_pos].mean()
        d_clean = np.where(is_pos, -prior * p / n_pos, p / n_unl)
        d = d_clean + np.where(is_pos, prior * (p - 1) / n_pos, 0) if clean >= 0 else -d_clean
        slope = np.bincount(table.column[at], np.repeat(d, table.sizes[rows]) * table.value[at], len(w))
        step = rate * (1 - 0.9 * i / steps)
        speed = 0.9 * speed - 0.1 * step * slope
        w += speed
        w = np.sign(w) * np.maximum(np.abs(w) - step * decay, 0)
        bias_speed = 0.9 * bias_speed - 0.001 * step * d.sum()
        bias += bias_speed
    x = table.scores(w, np.flatnonzero(apart))[0] + bias
    return w, bias + offset(x[positive[apart]], x[~positive[apart]], prior)


def offset(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """What to add to scores so that 0 lies between clean and toxic ones, as many spreads from either median.

    The clean ones are the unlabelled ones without the share ``prior`` that scores highest; they are many more, so their
    spread counts ``CAUTION`` times.
    """
    if not len(pos) or not len(unl):
        return 0.0
    clean = np.sort(unl)[: max(1, round(len(unl) * (1 - prior)))]
    (a, mid, b), (c, top, d) = np.quantile(clean, (0.25, 0.5, 0.75)), np.quantile(pos, (0.25, 0.5, 0.75))
    low, high = CAUTION * (b - a) + TINY, d - c + TINY
    return -float(mid * high + top * low) / (low + high)


def scorer(weights: dict[str, tuple[float, float]], bias: float, text_col: str = "text"):
    """Scores whole texts; ``weights`` gives each feature's part of the product and of the row's squared length."""

    def value(word: bytes) -> tuple[float, float]:
        found = [weights[f] for f in features(word) if f in weights]
        return sum(a for a, _ in found), sum(b for _, b in found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = Lexicon(), np.zeros((0, 2))
        for batch in blocks(batches, text_col):
            if len(lexicon) > LEXICON_WORDS:
                lexicon, table = Lexicon(), table[:0]
            codes, sizes = lexicon.codes(set(t.split()) for t in texts(text_of(batch, text_col)))
            new = lexicon.since(len(table))
            if new:
                table = np.concatenate([table, np.array([value(w) for w in new])])
            order = np.lexsort([codes, np.repeat(np.arange(len(sizes)), sizes)])  # sums don't depend on a set's order
            total = sums(table[codes[order]], sizes)
            out = logistic(total[:, 0] / np.sqrt(np.maximum(total[:, 1], TINY)) + bias)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(out)], ["id", "held_out", "score"])

    return tidy(run)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    prior: float | None = None,
    positives: int = 1_000,
    unlabelled: int = 3_000,
    longest: int = 50_000,
    least: int = 4,
    most: float = 0.3,
    steps: int = 300,
    lanes: int = 300,
    rate: float = 200.0,
    decay: float = 2e-5,
    seed: int = 3,
) -> tuple[dict[str, tuple[float, float]], float]:
    """(parts by feature, bias); features in fewer than ``least`` texts of the sample or in over a share ``most`` of its unlabelled texts are unused."""
    text = F.col(text_col).cast("string")
    # of a very long text, words by their hash; about ``longest`` bytes of it
    parts = F.ceil(F.octet_length(text) / longest)
    some = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.pmod(F.xxhash64(w), parts) == 0)
    text = F.when(F.octet_length(text) > longest, F.array_join(some, " ")).otherwise(text)
    rows = docs.where(learn).select(F.col(id_col).alias("id"), text.alias("text")).where("text IS NOT NULL")
    marks = labels.where(F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic_col).alias("toxic"))
    marks = rows.select("id").distinct().join(marks, "id")
    if prior is None:
        counted = marks.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
        prior = (counted["toxic"] or 0) / counted["n"] if counted["n"] else 0.0
        prior = min(0.9, prior) if 0 < prior < 1 else 0.1
    ids = hashed_sample(marks.where("toxic = 1"), positives, seed).withColumn("positive", F.lit(True))
    ids = ids.unionByName(hashed_sample(rows, unlabelled, seed + 1).withColumn("positive", F.lit(False)))
    sample = rows.join(F.broadcast(ids), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))  # a text an id

    def learned(sample: list[dict]) -> tuple[dict[str, tuple[float, float]], float]:
        sample = sorted(((r["positive"], r["text"]) for r in sample), key=lambda r: (zlib.crc32(r[1].encode("utf-8", "replace")), r))
        positive = np.array([p for p, _ in sample], bool)
        if positive.sum() < 2 or positive.all():
            least_prior = min(prior, 0.49)  # nothing is toxic without a model
            return {}, float(np.log(least_prior / (1 - least_prior)))
        table = Table([t.encode("utf-8", "replace") for _, t in sample], positive, least, most)
        w, bias = fit(table, positive, prior, steps=steps, lanes=lanes, rate=rate, decay=decay, seed=seed)
        return {f: (float(a * b), float(b * b)) for f, a, b in zip(table.names, w, table.weight, strict=True)}, bias

    return in_task(sample.select("text", "positive"), learned)  # positives + unlabelled rows at most


def score(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_id: str | None = None,
    **training,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row; ``learn`` says which rows may be learned from.

    ``sample_id`` is the id that labels refer to, where ``id_col`` is something else to hand on.
    """
    weights, bias = train(docs, labels, learn, id_col=sample_id or id_col, text_col=text_col, **training)
    rows = docs.select(F.col(id_col).alias("id"), (~learn).alias("held_out"), *texts_for(docs, id_col, text_col))
    out = rows.mapInArrow(scorer(weights, bias, text_col if sample_id else "text"), schema(docs.schema[id_col].dataType, held_out="boolean", score="double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic."""
    out = score(with_rows(docs), labels, learn, id_col="__row", sample_id=options.pop("id_col", "doc_id"), **options)
    return out.where("predicted = 0").select("__row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), fold("doc_id", FOLDS) != 0)
