"""Packing documents into sequences of a fixed number of tokens by cutting-stock column generation.

A document's ids end with ``END``. It is cut at multiples of the sequence length only, so a document that fits stays
whole. The pieces are counted by length in steps of ``STEP`` tokens; the linear program over these at most 512 counts
gives patterns (see ``cutting``), rounded and completed to whole numbers. Pieces of a length are ranked, and a piece's rank says
in which use of which pattern it goes. Real lengths are at most the counted ones, so nothing overflows.

The driver sees one count for each length step. Ranks come from counts by length and hash cell and a ranking inside
each cell, so a length that a third of all pieces have is ranked by many tasks.

A null text counts as empty: its ids are the end alone. Repeated rows and ids are packed one by one. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

from .common import LEXICON_WORDS, Lexicon, blocks, documents, ragged, schema, sums, texts, tidy
from .cutting import patterns
from .pieces import load, vocabulary

LENGTH = 4096
STEP = 8
END = 2
CELL_ROWS = 50_000
# Letters of ASCII and from U+00C0 to U+024F, but for U+0130, whose small form has two code points; then other signs of ASCII.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+"
MARKED = re.compile(rb"^(?:(" + LETTERS + rb")([!-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)
JOINED = 200


@lru_cache(1)
def loaded(path: str) -> tuple:
    """The tokeniser, and which of its ids end a word; read once by a process."""
    tokeniser = load(path)
    vocabulary = tokeniser.get_vocab()
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return tokeniser, ends_word


class WordIds:
    """Ids of words, found once for each distinct word of a task.

    The vocabulary drops white space and never joins characters across it, so a text's ids are those of its words in
    a row. Of a word of usual letters the case doesn't matter, and the signs behind it are a piece of their own, so words are
    put together from forms: each distinct one goes through the tokeniser once. The empty word stands for a text's end.
    """

    def __init__(self, path: str):
        self.tokeniser, self.ends_word = loaded(path)
        self.clear()

    def clear(self) -> None:
        self.words, self.forms = Lexicon(), Lexicon()
        self.starts, self.form_starts, self.form_sizes = (np.zeros(0, np.int64) for _ in range(3))
        self.sizes = np.zeros(0, np.int64)
        self.ids, self.form_ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.end = self.forms[b""]

    def _forms(self, words: list[bytes]) -> np.ndarray:
        """The one or two forms of each word; -1 for none."""
        forms, out = self.forms, []
        for letters, signs, other in MARKED.findall(b"\n".join(words)):
            if letters:
                small = letters.lower() if letters.isascii() else letters.decode().lower().encode()
                out += forms[small], forms[signs] if signs else -1
            else:
                out += forms[other], -1
        return np.array(out, np.int64).reshape(-1, 2)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, each with the end id, and how many each has."""
        if len(self.words) > LEXICON_WORDS:
            self.clear()
        codes, sizes = self.words.codes([*t.split(), b""] for t in docs)
        new = self.words.since(len(self.sizes))
        if new:
            forms = self._forms(new)
            self._learn()
            of = np.where(forms < 0, 0, self.form_sizes[forms])
            self.ids = np.concatenate([self.ids, self.form_ids[ragged(self.form_starts[forms].ravel(), of.ravel())]])
            self.sizes = np.concatenate([self.sizes, of.sum(1)])
            self.starts = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[codes]
        return self.ids[ragged(self.starts[codes], lengths)], sums(lengths, sizes)

    def _learn(self) -> None:
        new, ids, sizes = self.forms.since(len(self.form_sizes)), [self.form_ids], [self.form_sizes]
        for i in range(0, len(new), 10_000):
            own = [w.decode("utf-8", "replace") for w in new[i : i + 10_000]]
            flat, n = self._split(own)
            if not len(self.form_sizes) and i == 0:  # the form of the end
                flat, n = np.concatenate([np.array([END], np.uint32), flat]), n.copy()
                n[0] = 1
            sizes.append(n)
            ids.append(flat)
        self.form_ids, self.form_sizes = np.concatenate(ids), np.concatenate(sizes)
        self.form_starts = np.cumsum(self.form_sizes) - self.form_sizes

    def _split(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all forms in a row, and how many each has.

        Words of letters are encoded many at a time: the last id of each, and no other, is one that ends a word. Where
        that doesn't give as many ends as words, and for all other forms, each is encoded by itself.
        """
        plain, rest = [], []
        for k, w in enumerate(forms):
            (plain if w.isalpha() else rest).append(k)
        place, flat, sizes = [], [], []
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = self.tokeniser.encode_batch_fast([" ".join([forms[k] for k in g]) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(g) and ends[-1] == len(ids):
                place += g
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += g
        alone = [e.ids for e in self.tokeniser.encode_batch_fast([forms[k] for k in rest], add_special_tokens=False)]
        place += rest
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        flat.append(np.fromiter(chain.from_iterable(alone), np.uint32, int(sizes[-1].sum())))
        every = np.concatenate(sizes)
        back = np.argsort(np.asarray(place, np.int64), kind="stable")
        return np.concatenate(flat)[ragged((np.cumsum(every) - every)[back], every[back])], every[back]


PIECE = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"}


def cutter(path: str, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in blocks(batches, "text"):
            ids, sizes = words.encode(texts(batch.column("text")))
            n = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), n)
            start = ragged(np.zeros(len(n), np.int64), n) * length
            size = np.minimum(length, sizes[owner] - start)
            first = (np.cumsum(sizes) - sizes)[owner] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), size.tolist(), strict=True)]
            out = [batch.column("id").take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(sizes[owner])]
            yield pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return tidy(run)


def slots(found: list, step_of: str = "step") -> list[dict]:
    """For each width where its ranks go: from which rank on, the first sequence and how many uses of the pattern."""
    by: dict[int, dict] = {}
    first = 0
    for pattern, uses in found:
        for width, n in pattern:
            own = by.setdefault(width, {step_of: width, "ranks": [], "firsts": [], "uses": [], "next": 0})
            own["ranks"].append(own["next"])
            own["firsts"].append(first)
            own["uses"].append(uses)
            own["next"] += n * uses
        first += uses
    return [{k: v for k, v in x.items() if k != "next"} for x in by.values()]


def pack(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, step: int = STEP
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length % step:
        raise ValueError("the length is a multiple of the step")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(cutter(path, length), schema(docs.schema[id_col].dataType, **PIECE)), "pieces")
    pieces = pieces.withColumn("step", F.ceil(F.col("length") / step).cast("int"))
    demand = {r["step"]: r["count"] for r in pieces.groupBy("step").count().collect()}  # at most length / step rows
    table = json.dumps(slots(patterns(demand, length // step)))
    fields = "step: int, ranks: array<bigint>, firsts: array<bigint>, uses: array<bigint>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(table), f"array<struct<{fields}>>")))
    n_cells = max(1, -(-sum(demand.values()) // CELL_ROWS))
    order = ["id", "start", "ids_crc32"]
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n_cells)))
    counts = pieces.groupBy("step", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("step").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("step", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("step", "cell").orderBy(*order)) - 1
    pieces = pieces.withColumn("inside", inside).join(counts, ["step", "cell"])
    pieces = pieces.withColumn("rank", F.col("before") + F.col("inside"))
    pieces = pieces.join(F.broadcast(table), "step")  # at most length / step rows
    at = F.size(F.filter("ranks", lambda r: r <= F.col("rank")))
    pieces = pieces.withColumn("at", at)
    place = F.col("rank") - F.element_at("ranks", F.col("at"))
    sequence = F.element_at("firsts", F.col("at")) + place % F.element_at("uses", F.col("at"))
    pieces = pieces.withColumn("sequence_id", sequence)
    upto = W.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(upto), F.lit(0))
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )


def op2_cutting_stock(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
