"""Public tokenisers over whole texts, piece by piece: the texts of a task share the work on equal pre-tokens.

``token_counts`` counts the tokens of each text. A text is cut into pre-tokens by the tokeniser's own rule (once for each
distinct run between plain spaces); the pieces of each distinct pre-token of a task are counted once, the counts are joined
to the pre-token frequencies of each document by the pre-token's number, and summed. Only numbers of pieces are kept, never ids. A task keeps at most ``LEXICON_WORDS``
pre-tokens besides those of its block and begins a new table beyond that.

Added special tokens inside a text count as one token each, as the library does by default. Null and empty texts have no
token. Repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEXICON_WORDS, Lexicon, blocks, documents, ragged, schema, sums, tidy

LIMIT = 512
def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokeniser of a .json file, without threads of its own beside Spark's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def disputed(tokeniser) -> dict[str, str]:
    """Code points that the regex module calls letters (L) or numbers (N) and the tokeniser doesn't.

    Both follow Unicode, the module a newer version. Where Python's own, older tables agree with the module's, so do the
    tokeniser's; only the rest is tried one by one.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for kind, before in (("L", "a"), ("N", "1")):
        here = regex.findall(rf"\p{{{kind}}}", every)
        new = [c for c in here if unicodedata.category(c)[0] != kind]
        out[kind] = "".join(c for c in new if len(tokeniser.pre_tokenizer.pre_tokenize_str(before + c)) == 2)
    return out


def ranges(members: Iterable[str]) -> str:
    """The inside of a character class with these members."""
    codes = np.array(sorted(map(ord, members)), np.int64)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1) if len(codes) else []
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


class ByteLevelRule:
    """Cuts texts into pre-tokens as the tokeniser of a byte-level vocabulary does."""

    def __init__(self, path: str, less: dict[str, str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec.get("pre_tokenizer") or {}
        if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without prefix space and normalizer is needed")
        self.marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")") if self.marks else None
        self.usual = self._rule(r"\p{L}", r"\p{N}")
        self.exact = self._rule(*(rf"[\p{{{k}}}--[{ranges(less[k])}]]" if less[k] else rf"\p{{{k}}}" for k in "LN"))
        self.odd = frozenset(less["L"] + less["N"])

    @staticmethod
    def _rule(letter: str, number: str) -> regex.Pattern:
        # English endings, then words, numbers and signs with one space before them, then white space.
        space = r"\p{White_Space}"
        sign = rf"[^{space}{letter}{number}]"
        rule = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{sign}+|{space}+(?!\P{{White_Space}})|{space}+"
        return regex.compile(rule, regex.V1)

    def cut(self, text: str) -> list[str]:
        rule = self.usual if text.isascii() or self.odd.isdisjoint(text) else self.exact
        if not any(m in text for m in self.marks):
            return rule.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else rule.findall(part)
        return out


WIDE = re.compile(r"^\s|\s$| \s|\s ")


def chunks(text: str) -> list[str]:
    """Cuts where a pre-token surely begins: at a space between two characters that aren't white space."""
    parts = text.split(" ")
    if not WIDE.search(text):
        return [parts[0], *(" " + p for p in parts[1:])]
    out, own, open_end = [], [parts[0]], not parts[0] or parts[0][-1].isspace()
    for p in parts[1:]:
        if open_end or not p or p[0].isspace():
            own.append(p)
        else:
            out.append(" ".join(own))
            own = ["", p]
        open_end = not p or p[-1].isspace()
    out.append(" ".join(own))
    return out


class PreTokens:
    """Numbers of the pre-tokens of texts, by way of the distinct chunks of a task, and their numbers of pieces."""

    def __init__(self, path: str, less: dict[str, str]):
        self.tokeniser, self.rule = load(path), ByteLevelRule(path, less)
        self.clear()

    def clear(self) -> None:
        self.chunks, self.lexicon = Lexicon(), Lexicon()
        self.starts = self.lengths = self.codes_of = np.zeros(0, np.int64)
        self.pieces = np.zeros(0, np.int64)

    def codes(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > LEXICON_WORDS:
            self.clear()
        at, sizes = self.chunks.codes(map(chunks, docs))
        new, lengths = self.lexicon.codes(map(self.rule.cut, self.chunks.since(len(self.starts))))
        self.codes_of = np.concatenate([self.codes_of, new])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._count()
        return self.codes_of[ragged(self.starts[at], self.lengths[at])], sums(self.lengths[at], sizes)

    def _count(self) -> None:
        new = self.lexicon.since(len(self.pieces))
        counted = [self.pieces]
        for i in range(0, len(new), 10_000):
            found = self.tokeniser.encode_batch_fast(new[i : i + 10_000], add_special_tokens=False)
            counted.append(np.fromiter((len(e.ids) for e in found), np.int64, len(found)))
        self.pieces = np.concatenate(counted)


def frequencies(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, how often) for each distinct code of each document."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    keys, n = np.unique((doc << 32) | codes, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def counter(path: str, less: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(path, less)
        for batch in blocks(batches, "text"):
            own = [t or "" for t in batch.column("text").to_pylist()]
            doc, code, n = frequencies(*tokens.codes(own))
            total = np.bincount(doc, tokens.pieces[code] * n, len(own)).astype(np.int64)
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(total)], ["id", "n_bytes", "n_tokens"])

    return tidy(run)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    count = counter(path, disputed(load(path)))
    return rows.mapInArrow(count, schema(docs.schema[id_col].dataType, n_bytes="long", n_tokens="long")).withColumnRenamed("id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
