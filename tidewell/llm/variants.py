"""Spelling variants: words that are one edit apart, by asymmetric q-chunks, and the form that each word leads to.

The shorter word of a pair (any one if both are as long) gives its two halves, disjoint chunks of q code points at the
positions 0 and q; the other one gives all its positional grams of q code points. One inserted, deleted or replaced
code point spoils one chunk at most, so the other one is among the grams of the near word, moved by one place at most.
Both sides meet on (length of the shorter word, gram, position within one), and an edit distance decides.

Where many words meet on one gram, not all their pairs are looked at: without the gram, at its place in both, near
words are still one edit apart, so the same split is applied to what is left of them. Each round halves what is left,
until words of a group differ in one or two places only. So no link is lost and no group is compared pair by pair.

Words are maximal runs of letters (A-Z lowered), counted over all texts; where crc32 of ``<id>:<word>`` is divisible by
``SLIP``, the word's code point at that number modulo its length is left out, as a slip of the pen would. A word's form
is its near word of largest count (ties: the smallest in code-point order) if it occurs ``TIMES`` times as often; the
root follows forms to the last. Counts at least double from form to form, so there are no circles.

Defined results: null and empty texts have no words; a null id counts as the empty text; repeated rows count as often as
they occur. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.durable import stored

from .common import documents
from .merkle import LOWER, UPPER, crc32_sql

LETTERS = "[A-Za-zÀ-ÿ]+"
SLIP, SHORTEST, RAREST, TIMES = 97, 5, 3, 2
MEETINGS = 128  # pairs for each word on a gram above which the words are split once more


def spelled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points and ``rarest`` uses."""
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.where(F.length("run") >= shortest)
    plain = F.col("run") == F.lower("run")  # then no A-Z; lower() also changes other letters
    rows = rows.select("id", F.when(plain, F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.pmod("h", F.lit(slip)) == 0, slipped).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


def _without(place: Column, q: Column) -> Column:
    """``rest`` without the ``q`` code points after ``place``."""
    return F.concat(F.substring("rest", F.lit(1), place), F.substring("rest", place + q + 1, F.length("rest")))


def _keyed(rows: DataFrame, gram: Column) -> DataFrame:
    """A row for each of (size, place, from): the gram of q code points at ``from`` is looked up at ``place``."""
    rows = rows.withColumn("gram", F.explode(gram)).select("*", "gram.*").drop("gram")
    key = F.xxhash64("key", "size", "place", F.substring("rest", F.col("from") + 1, F.col("q")))
    return rows.select("word", "n", key.alias("key"), _without(F.col("from"), F.col("q")).alias("rest"))


def chunks(rows: DataFrame) -> DataFrame:
    """The two halves of each word, at their places and one to either side."""
    size = F.length("rest")
    q = F.floor(size / 2).cast("int")
    places = [(start, d) for start in (F.lit(0), q) for d in (-1, 0, 1)]
    gram = [F.struct(size.alias("size"), (start + d).alias("place"), start.alias("from"), q.alias("q")) for start, d in places]
    return _keyed(rows, F.filter(F.array(*gram), lambda g: g["place"] >= 0))


def grams(rows: DataFrame) -> DataFrame:
    """All positional grams of each word, for shorter words of its length or one less."""

    def of(size: Column) -> Column:
        q = F.floor(size / 2).cast("int")
        places = F.sequence(F.lit(0), F.length("rest") - q)
        return F.transform(places, lambda p: F.struct(size.alias("size"), p.alias("place"), p.alias("from"), q.alias("q")))

    length = F.length("rest")
    shorter = F.when(length > 1, of(length - 1))
    return _keyed(rows, F.concat(of(length), F.coalesce(shorter, F.filter(of(length), lambda g: F.lit(False)))))


def links(words: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words one edit apart, once each."""
    side = words.select("word", "n", F.lit(0).cast("long").alias("key"), F.col("word").alias("rest"))
    left, right, found = chunks(side), grams(side), []
    while True:
        left, right = stored(left, "chunks"), stored(right, "grams")
        few = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.length("rest")).alias("size"))
        few = few.join(right.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "key")
        hot = stored(few.where((F.col("c") * F.col("g") > meetings * (F.col("c") + F.col("g"))) & (F.col("size") > 1)).select("key"), "hot")
        a, b = left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti")
        a = a.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = b.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
        pairs = a.join(b, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
        found.append(stored(pairs.select("a", "n_a", "b", "n_b").distinct(), "links"))
        if hot.isEmpty():
            break
        left, right = chunks(left.join(hot, "key", "left_semi")), grams(right.join(hot, "key", "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps taken; rounds grow with the logarithm of the chain."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def variants(words: DataFrame, *, times: int = TIMES, meetings: int = MEETINGS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n); words have to be distinct."""
    words = stored(words, "words")
    pairs = links(words, meetings)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    near = words.join(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "word", "left")
    leads = -F.col("best.m") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n"))
    near = stored(near, "forms")
    roots = last_forms(near.where("form IS NOT NULL"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spelled(documents(spark, sf_dir)))


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{UPPER}', '{LOWER}') AS run FROM documents),
uses AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, k, {crc32_sql("id || ':' || run")} AS h FROM uses),
slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(k) >= {RAREST}),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {TIMES} * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= {TIMES} * w.n THEN (SELECT min(near) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.at AND l.form IS NULL
"""
