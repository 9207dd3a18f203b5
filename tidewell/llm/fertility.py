"""Quality rules: repetition and length first, then the fertility of public tokenisers.

Measured for each text, word by word (words are runs without ASCII white space):

* characters per token of a byte-level vocabulary: low for random strings, high for long runs of one symbol;
* characters per piece of a vocabulary with byte fallback: low for digits, hex, base64 and broken encodings;
* the share of its byte-fallback pieces: high for broken or unusual characters;
* the entropy of the text's token ids in bits: low for a few tokens said over and over, high for random ones.

Each measure has bands for the script of most of the text's letters; a text outside one of its bands is rejected. A
text without letters has the script ``none``. Tokens of a word are found once for each distinct word of a task.

Bands are learned from all rows that pass the base rules, by script and size class (the whole logarithm of the number of
words to base 2, for entropy and spread depend on it): from the median to the ``TAIL_SHARE`` and 1 - ``TAIL_SHARE``
quantiles, and beyond them by (``MARGIN`` + ``FEW`` / rows of the class) of that distance plus a fixed ``SLACK``. So a
class of few rows has wide bands, and a row that is alone is inside. Quantiles come from counts of values in steps of
``STEP`` up to ``TOP``, which add up exactly in any order. ``BANDS`` are limits that hold whatever the rows say: bad texts
that make up more than ``TAIL_SHARE`` of a class widen its learned bands.

Null and empty texts have no words: they fail the base rules (fewer than ``MIN_WORDS`` words), are rejected, and their
measures are null. Repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

from .common import LEXICON_WORDS, Lexicon, blocks, documents, ragged, schema, sums, texts, tidy
from .pieces import load, vocabulary

MIN_WORDS = 20
SPAN = 8
SYMBOLS = frozenset(b"#*$%&|<>")
# Script -> (fewest, most) characters per token, largest byte-fallback share, least entropy in bits, fewest
# characters per piece.
BANDS = {
    "latin": (1.2, 12.0, 0.25, 2.5, 1.25),
    "cyrillic": (0.5, 8.0, 0.25, 2.5, 1.0),
    "greek": (0.4, 8.0, 0.5, 2.5, 0.3),
    "arabic": (0.4, 8.0, 0.5, 2.5, 0.3),
    "hebrew": (0.4, 8.0, 0.5, 2.5, 0.3),
    "devanagari": (0.3, 8.0, 0.7, 2.5, 0.3),
    "cjk": (0.3, 8.0, 0.7, 2.5, 0.3),
    "hiragana": (0.3, 8.0, 0.7, 2.5, 0.3),
    "katakana": (0.3, 8.0, 0.7, 2.5, 0.3),
    "hangul": (0.3, 8.0, 0.8, 2.5, 0.3),
    "other": (0.2, 12.0, 1.0, 2.5, 0.3),
    "none": (0.8, 12.0, 0.5, 2.5, 1.25),
}
TAIL_SHARE, MARGIN, FEW = 0.05, 1.0, 20.0
STEP, TOP = 0.01, 20.0
# measure -> slack, which of its sides are judged
MEASURES = {
    "chars_per_token": (0.05, "low", "high"),
    "chars_per_piece": (0.05, "low"),
    "byte_share": (0.05, "high"),
    "entropy": (0.1, "low", "high"),
}
SCRIPTS = list(BANDS)
_script_of: dict[str, int] = {}


def script(ch: str) -> int:
    """Number of the script of a letter by its Unicode name, or that of ``none``."""
    n = _script_of.get(ch)
    if n is None:
        name = unicodedata.name(ch, "").split(" ")[0].lower() if ch.isalpha() else "none"
        n = _script_of[ch] = SCRIPTS.index(name) if name in BANDS else SCRIPTS.index("other")
    return n


class Words:
    """What each distinct word of a task adds to the measures of its text."""

    def __init__(self, byte_level: str, fallback: str):
        import sentencepiece

        self.byte_level = load(byte_level)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=fallback)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.lexicon = Lexicon()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.table = np.zeros((0, 4), np.int64)  # characters, symbols, pieces, byte pieces
        self.letters = np.zeros((0, len(SCRIPTS)), np.int32)

    def codes(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.lexicon) > LEXICON_WORDS:
            self.clear()
        codes, sizes = self.lexicon.codes(t.split() for t in docs)
        new = self.lexicon.since(len(self.starts))
        ids, lengths, tables, letters = [self.ids], [self.lengths], [self.table], [self.letters]
        for i in range(0, len(new), 10_000):
            raw = new[i : i + 10_000]
            own = [w.decode("utf-8", "replace") for w in raw]
            got = [e.ids for e in self.byte_level.encode_batch_fast([" " + w for w in own], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((x for e in got for x in e), np.int32, int(lengths[-1].sum())))
            found = self.pieces.encode(own, num_threads=1)
            n = np.fromiter(map(len, found), np.int64, len(found))
            is_byte = self.is_byte[np.fromiter((x for e in found for x in e), np.int64, int(n.sum()))].astype(np.int64)
            symbols = [sum(c in SYMBOLS for c in w) if not w.isalnum() else 0 for w in raw]
            tables.append(np.stack([np.fromiter(map(len, own), np.int64, len(own)), np.asarray(symbols), n, sums(is_byte, n)], 1))
            by = np.zeros((len(own), len(SCRIPTS)), np.int32)
            for k, w in enumerate(own):
                if raw[k].isalpha():
                    by[k, 0] = len(w)
                else:
                    for c in w:
                        by[k, script(c)] += 1
            letters.append(by)
        if new:
            self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
            self.table, self.letters = np.concatenate(tables), np.concatenate(letters)
            self.starts = np.cumsum(self.lengths) - self.lengths
        return codes, sizes


def repeated_words(codes: np.ndarray, sizes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each document the words that lie in a window of ``span`` words found twice or more in it.

    Windows are found by a 64-bit hash and then compared word by word.
    """
    n = len(codes)
    if n < span:
        return np.zeros(len(sizes), np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    factor, key = np.uint64(0x9E3779B97F4A7C15), np.zeros(n - span + 1, np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for i in range(span):
        key = key * factor + mixed[i : n - span + 1 + i]
    inside = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    key = (key[inside] + doc[inside].astype(np.uint64)) * factor
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(sizes), np.int64)
    at = inside[np.isin(key, twice)]
    rows = np.column_stack([doc[at], *(codes[at + i] for i in range(span))])
    order = np.lexsort(rows.T[::-1])
    same = (rows[order][1:] == rows[order][:-1]).all(1)
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + span, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), sizes)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of the distribution of ids in each document."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    keys, n = np.unique((doc << 32) | ids, return_counts=True)
    share = n / sizes[keys >> 32]
    return np.bincount(keys >> 32, -share * np.log2(share), len(sizes))


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "script": "string", "chars_per_token": "double", "chars_per_piece": "double", "byte_share": "double", "entropy": "double",
    "in_limits": "boolean",
}


def measure(byte_level: str, fallback: str, bands: dict[str, tuple[float, ...]]):
    limits = np.array([bands.get(s, bands["other"]) for s in SCRIPTS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(byte_level, fallback)
        for batch in blocks(batches, "text"):
            own = texts(batch.column("text"))
            codes, sizes = words.codes(own)
            total = sums(words.table[codes], sizes)
            tokens = sums(words.lengths[codes], sizes)
            letters = sums(words.letters[codes].astype(np.int64), sizes)
            letters[:, SCRIPTS.index("none")] = 0
            kind = np.where(letters.sum(1) > 0, letters.argmax(1), SCRIPTS.index("none"))
            ids = words.ids[ragged(words.starts[codes], words.lengths[codes])]
            per_token = total[:, 0] / np.maximum(tokens, 1)
            per_piece = total[:, 0] / np.maximum(total[:, 2], 1)
            share, bits = total[:, 3] / np.maximum(total[:, 2], 1), entropy(ids, tokens)
            least, most, bytes_most, bits_least, piece_least = limits[kind].T
            good = (per_token >= least) & (per_token <= most) & (per_piece >= piece_least) & (sizes > 0)
            good &= (share <= bytes_most) & (bits >= bits_least)
            none = sizes == 0
            out = [sizes, total[:, 0], total[:, 1], np.fromiter(map(repeated_lines, own), np.int64, len(own)),
                   repeated_words(codes, sizes), np.array(SCRIPTS, dtype=object)[kind]]
            out = [pa.array(x) for x in out] + [pa.array(x, mask=none) for x in (per_token, per_piece, share, bits)] + [pa.array(good)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out], ["id", *COLUMNS])

    return tidy(run)


def learned(measured: DataFrame) -> DataFrame:
    """(of_script, of_size, <measure>_low, <measure>_high, ...): bands of each script and size class, some hundred rows."""
    bins = F.array(*(F.struct(F.lit(m).alias("m"), F.floor(F.least(F.col(m), F.lit(TOP)) / STEP).alias("bin")) for m in MEASURES))
    counts = measured.select("script", "size_class", F.inline(bins)).groupBy("script", "size_class", "m", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("script", "size_class", "m")  # TOP / STEP rows at most
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})

    def quantile(q: float):
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bin")))

    cells = counts.groupBy("script", "size_class", "m").agg(
        quantile(TAIL_SHARE).alias("low"), quantile(0.5).alias("mid"), quantile(1 - TAIL_SHARE).alias("high"), F.max("all").alias("rows")
    )
    out = F.lit(MARGIN) + F.lit(FEW) / F.col("rows")
    low = (F.col("low") - out * (F.col("mid") - F.col("low"))) * STEP
    high = (F.col("high") + 1 + out * (F.col("high") - F.col("mid"))) * STEP
    sides = []
    for m, (slack, *judged) in MEASURES.items():
        for side, limit in (("low", low - slack), ("high", high + slack)):
            if side in judged:
                sides.append(F.max(F.when(F.col("m") == m, limit)).alias(f"{m}_{side}"))
    return cells.groupBy(F.col("script").alias("of_script"), F.col("size_class").alias("of_size")).agg(*sides)


def inside() -> Column:
    """Whether the measures lie in the bands joined to their row."""
    out = F.lit(True)
    for m, (_, *judged) in MEASURES.items():
        if "low" in judged:
            out &= F.col(m) >= F.col(f"{m}_low")
        if "high" in judged:
            out &= (F.col(m) <= F.col(f"{m}_high")) | (F.col(m) >= TOP)  # beyond TOP only the fixed limits judge
    return out


def quality(
    docs: DataFrame,
    byte_level: str,
    fallback: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: dict[str, tuple[float, ...]] = BANDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Counts, measures, ``base_failed``, ``in_bands`` and ``kept`` for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(measure(byte_level, fallback, dict(bands)), schema(docs.schema[id_col].dataType, **COLUMNS))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    size = F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))).cast("int")
    out = stored(out.withColumns({"base_failed": failed, "size_class": size}), "measures")
    limits = learned(out.where("NOT base_failed"))
    same = (F.col("script") == F.col("of_script")) & (F.col("size_class") == F.col("of_size"))
    own = out.join(F.broadcast(limits), same, "left")  # a row a script and size class
    ok = F.col("in_limits") & F.coalesce(inside(), F.lit(True))  # no bands: no row of the class passed the base rules
    out = own.select(*out.columns, ok.alias("in_bands")).drop("size_class", "in_limits")
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))
    return out.withColumnRenamed("id", id_col)


def op8_fertility(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
