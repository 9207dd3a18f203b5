"""Near-duplicate texts by n-gram Jaccard similarity: signature trees inside groups that share a rare shingle.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z lowered, words are runs without ASCII white space); a
shorter text is one shingle, a text without words has none and links with nothing. Two texts link when
100 * intersection >= percent * union. The join is exact up to collisions of 64-bit hashes.

1. Equal sets become one class, so copies cost one row each and meet nobody. A class is named by a hash of its set, for
   an id may hold several texts.
2. One order of all shingles, hashes with the corpus's most frequent shingles last, gives each class a prefix: texts that
   link share a shingle of both prefixes. Classes that share one are a group; groups with equal members count once. Above
   50 percent different sets that link share two shingles, and prefixes longer by one hold two of them; so two classes that
   are alone in their only group don't link, and nothing of them is moved any more.
3. A group's classes are leaves of trees, by size. A node holds the OR of its classes' bitmaps, their range of sizes and
   the most shingles that a bitmap hides. A dual traversal drops pairs of nodes whose sizes or largest possible overlap
   don't allow a link, and pairs of leaves that are connected already. What is left is a spanning forest of possible links.
4. Possible links are checked on the whole texts. Where a check fails, the forest may have hidden a link behind it: the
   classes connected to a failed pair are traversed once more, without a forest, so that every possible link between
   different components is checked.
5. Components of the links, with the smallest id as name. A class is the node of its smallest id there; an id with several
   texts is linked with the smallest id of each.

A group of more than ``GROUP`` classes is cut into blocks, and each pair of blocks is a group of its own. Nothing is
capped; the list of frequent shingles (``FREQUENT`` at most) only shapes the order. Bitmaps move only for classes that
share a shingle with another one, texts only for classes of possible links.

Rows that repeat an id are one node, also with other texts or none. A null id can't be named and stays alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

from .common import LEXICON_WORDS, Lexicon, blocks, documents, release, texts, tidy
from .components import components

SHINGLE = 5
PERCENT = 75
FREQUENT = 1 << 17
COUNTED_BYTES = 8 << 20
GROUP = 4096
BITS = 4  # for a shingle at least, up to twice as many; they are most of what moves for texts that meet
LEAF, FAN = 16, 8
CELL_ROWS = 2_000
SEEN = 1 << 17
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Sets of shingle hashes; the hash of a word is found once for each distinct word of a task."""

    def __init__(self, n: int):
        self.n, self.lexicon, self.hashes = n, Lexicon(), np.zeros(0, U)

    def sets(self, docs: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text."""
        if len(self.lexicon) > LEXICON_WORDS // 4:
            self.lexicon, self.hashes = Lexicon(), np.zeros(0, U)
        codes, sizes = self.lexicon.codes(t.lower().split() for t in docs)
        new = self.lexicon.since(len(self.hashes))
        more = np.fromiter(map(xxhash.xxh3_64_intdigest, new), U, len(new))
        self.hashes = np.concatenate([self.hashes, more])
        h = self.hashes[codes]
        runs = np.zeros(max(0, len(h) - self.n + 1), U)
        for i in range(self.n):
            runs = runs * U(0x9E3779B97F4A7C15) + h[i : i + len(runs)]
        runs = mix(runs)
        out, start = [], 0
        for k in sizes.tolist():
            if k >= self.n:
                out.append(np.unique(runs[start : start + k - self.n + 1]))
            elif k:
                out.append(np.array([xxhash.xxh3_64_intdigest(h[start : start + k].tobytes(), seed=k)], U))
            else:
                out.append(np.zeros(0, U))
            start += k
        return out


def common_shingles(n: int):
    """Shingles of several texts of a block, with the number of texts; only those of at least one text in 500."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in blocks(batches, "text", COUNTED_BYTES):
            sets = shingles.sets(texts(batch.column("text")))
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, U)
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            found = np.diff(np.r_[starts, len(every)])
            often = found >= max(3, len(sets) // 500)
            yield pa.RecordBatch.from_arrays([pa.array(every[starts[often]].view(np.int64)), pa.array(found[often])], ["h", "n"])

    return tidy(run)


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name for a set, by its size and two sums over it."""
    sums = np.array([s.sum(dtype=U), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)])
    return int(np.uint64(xxhash.xxh3_64_intdigest(sums.tobytes(), seed=len(s))).view(np.int64))


def needed(n: int, percent: int) -> int:
    """Fewest common shingles of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def signatures(n: int, percent: int, frequent: np.ndarray):
    """Size, class, bitmap and prefix of each text's set; ``frequent`` is sorted.

    Copies that a task meets again (among the last ``SEEN`` classes) have no bitmap and prefix.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(n), set()
        for batch in blocks(batches, "text"):
            sets = shingles.sets(texts(batch.column("text")))
            flat = np.concatenate(sets) if sets else np.zeros(0, U)
            at = np.minimum(np.searchsorted(frequent, flat), max(0, len(frequent) - 1))
            late = frequent[at] == flat if len(frequent) else np.zeros(len(flat), bool)
            bits, prefixes, start, kinds = [], [], 0, list(map(class_of, sets))
            for s, kind in zip(sets, kinds, strict=True):
                own, start = late[start : start + len(s)], start + len(s)
                if kind in seen:
                    bits.append(None)
                    prefixes.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(kind)
                width = max(64, 1 << (BITS * len(s) - 1).bit_length()) if len(s) else 64
                b = np.zeros(width, bool)
                b[(s & U(width - 1)).astype(np.int64)] = True
                bits.append(np.packbits(b, bitorder="little").tobytes())
                p = len(s) - needed(len(s), percent) + (2 if percent > 50 else 1) if len(s) else 0
                prefixes.append(np.concatenate([s[~own][:p], s[own]])[:p].view(np.int64))
            size = pa.array(np.fromiter(map(len, sets), np.int64, len(sets)))
            out = [batch.column("id"), size, pa.array(kinds, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["id", "n", "class", "bits", "prefix"])

    return tidy(run)


# --- signature trees


class Forest:
    """Which classes of a cell are connected."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.up[at]
        while True:
            above = self.up[top]
            if (above == top).all():
                self.up[at] = top
                return top
            top = above

    def join(self, a: int, b: int) -> bool:
        a, b = (int(x) for x in self.roots(np.array([a, b])))
        self.up[max(a, b)] = min(a, b)
        return a != b


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: bits that share a place are combined."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """Levels of nodes over classes sorted by size; level 0 are leaves of ``LEAF`` classes."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.at, self.sizes, self.bits = at, sizes, bits
        self.hidden = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
        step = np.arange(0, len(at), LEAF)
        self.levels = [self._level(bits, sizes, sizes, self.hidden, step)]
        while len(self.levels[-1][1]) > 1:
            low = self.levels[-1]
            self.levels.append(self._level(*low, np.arange(0, len(low[1]), FAN)))

    @staticmethod
    def _level(bits, least, most, hidden, step):
        return (np.bitwise_or.reduceat(bits, step), np.minimum.reduceat(least, step), np.maximum.reduceat(most, step), np.maximum.reduceat(hidden, step))

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, (i + 1) * LEAF)


def allowed(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of nodes whose sizes and largest possible overlap allow a link."""
    least = (100 + percent) * np.minimum(a[2][i], b[2][j])  # a link needs percent * (x + y) of (100 + percent) * overlap
    close = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    overlap = np.minimum(overlap * (100 + percent), least)
    return close & (overlap >= percent * (a[1][i] + b[1][j]))


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may hold links, nearest to the start first; each once where both trees are the same."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = allowed(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[ok], j[ok]
        if not len(i) or la == lb == 0:
            break
        if la >= lb:
            i, j, la = (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN), la - 1
        if lb > la:
            i, j, lb = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel(), lb - 1
        ok = (i < len(a.levels[la][1])) & (j < len(b.levels[lb][1]))
        if a is b and la == lb:
            ok &= i <= j
        i, j = i[ok], j[ok]
    yield from zip(i.tolist(), j.tolist(), strict=True)


def possible(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """The largest possible similarity of each pair, from the shingles that one bitmap has and the other lacks.

    Pairs that can't link get -1.
    """
    only_x = np.bitwise_count(x[:, None, :] & ~y[None, :, :]).sum(2).astype(np.int64)
    only_y = np.bitwise_count(y[None, :, :] & ~x[:, None, :]).sum(2).astype(np.int64)
    both = nx[:, None] + ny[None, :]
    overlap = np.minimum(nx[:, None] - only_x, ny[None, :] - only_y)
    return np.where((100 + percent) * overlap >= percent * both, overlap / (both - overlap), -1.0)


def trees(at: np.ndarray, sizes: np.ndarray, raw: list[bytes], ids: np.ndarray) -> dict[int, Tree]:
    """A tree for each width of bitmaps, by number of words; classes in order of size."""
    at = at[np.lexsort([ids[at], sizes[at]])]
    words = np.array([len(raw[i]) // 8 for i in at], np.int64)
    out = {}
    for w in np.unique(words).tolist():
        own = at[words == w]
        out[w] = Tree(own, sizes[own], np.frombuffer(b"".join(raw[i] for i in own), "<u8").reshape(len(own), w))
    return out


def tree_pairs(first: dict[int, Tree], second: dict[int, Tree]) -> Iterator[tuple[Tree, Tree]]:
    """Trees whose classes may be of similar size, with bitmaps of the same width."""
    for wa, a in first.items():
        for wb, b in second.items():
            if (first is second and wa > wb) or max(wa, wb) > 2 * min(wa, wb):
                continue
            if wa < wb:
                yield a, Tree(b.at, b.sizes, folded(b.bits, wa))
            elif wb < wa:
                yield Tree(a.at, a.sizes, folded(a.bits, wb)), b
            else:
                yield a, b


def candidates(pairs: list[tuple[Tree, Tree]], component, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, classes, largest possible similarity of each pair) of leaves; -1 where no link between components is possible."""
    for a, b in pairs:
        for i, j in traverse(a, b, percent):
            x, y = a.leaf(i), b.leaf(j)
            apart = component(a.at[x])[:, None] != component(b.at[y])[None, :]
            if apart.any():
                most = possible(a.bits[x], a.sizes[x], b.bits[y], b.sizes[y], percent)
                most[~apart] = -1
                if (most > 0).any():
                    yield a.at[x], b.at[y], most


def joiner(percent: int, forest_only: bool):
    """Possible links of the groups of a cell: a spanning forest, or every one between different components.

    For the forest every class of a group proposes its most similar one in another component, until none is left, so
    that a link is rarely hidden behind a pair that turns out not to be one.
    """

    def run(cell: pa.Table) -> pa.Table:
        ids, sizes, raw = np.asarray(cell.column("class")), np.asarray(cell.column("n")), cell.column("bits").to_pylist()
        known = np.asarray(cell.column("component"))
        posts = cell.column("posts").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(posts.offsets)))
        flat = posts.flatten()
        group, blk, bi, bj = (np.asarray(flat.field(k)) for k in ("grp", "blk", "bi", "bj"))
        forest, out = Forest(len(ids)), set()
        component = forest.roots if forest_only else known.__getitem__
        order = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True]) + 1 if len(order) else []
        start = 0
        for end in ends:
            at, start = order[start:end], end
            own = owner[at]
            if len(at) < 2 or len(np.unique(component(own))) < 2:
                continue
            first = trees(own[blk[at] == bi[at]], sizes, raw, ids)
            second = first if bi[at[0]] == bj[at[0]] else trees(own[blk[at] == bj[at]], sizes, raw, ids)
            pairs = list(tree_pairs(first, second))
            while True:
                best, partner = dict.fromkeys(own.tolist(), -1.0), {}
                for x, y, most in candidates(pairs, component, percent):
                    if not forest_only:
                        for p, q in np.argwhere(most > 0).tolist():
                            u, v = int(ids[x[p]]), int(ids[y[q]])
                            out.add((min(u, v), max(u, v)))
                        continue
                    for here, there, m in ((x, y, most), (y, x, most.T)):
                        k = m.argmax(1)
                        for p in np.flatnonzero(m[np.arange(len(here)), k] > 0).tolist():
                            u, value = int(here[p]), float(m[p, k[p]])
                            if value > best[u]:
                                best[u], partner[u] = value, int(there[k[p]])
                joined = False
                for u in sorted(partner, key=lambda u: (-best[u], ids[u])):
                    if forest.join(u, partner[u]):
                        joined = True
                        a, b = int(ids[u]), int(ids[partner[u]])
                        out.add((min(a, b), max(a, b)))
                if not joined:
                    break
        found = sorted(out)
        release()
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return run


def verifier(n: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                x, y = shingles.sets(texts(batch.column("text_a"))), shingles.sets(texts(batch.column("text_b")))
                linked = []
                for s, t in zip(x, y, strict=True):
                    both = np.concatenate([s, t])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * common >= percent * (len(s) + len(t) - common) > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return tidy(run)


def class_texts(n: int):
    """The class of each text, for an id may have several."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in blocks(batches, "text"):
            kinds = pa.array(list(map(class_of, shingles.sets(texts(batch.column("text"))))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("class"), kinds, batch.column("text")], ["class", "own", "text"])

    return tidy(run)


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) for classes by the whole texts of both; pairs are stored."""
    keys = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class"), "keys")
    some = rows.join(keys.withColumnRenamed("rep", "id"), "id").select("class", "text").mapInArrow(class_texts(n), "class long, own long, text string")
    some = some.where("own = class").select("class", "text").dropDuplicates(["class"])
    one = pairs.join(some.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(some.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(two.select("a", "b", "text_a", "text_b").mapInArrow(verifier(n, percent), "a long, b long, linked boolean"), "verified")


def near_texts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common = rows.select("text").mapInArrow(common_shingles(shingle), "h long, n long")
    top = common.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).select("h")
    frequent = np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(U))  # at most FREQUENT
    schema = "id long, n long, class long, bits binary, prefix array<long>"
    sets = stored(rows.mapInArrow(signatures(shingle, percent, frequent), schema), "sets")
    some = sets.where("n > 0 AND id IS NOT NULL")
    classes = stored(some.groupBy("class").agg(F.min("id").alias("rep")), "classes")
    # groups of classes that share a shingle of their prefixes; one for each set of members
    first = some.where("prefix IS NOT NULL")
    posts = first.select("class", F.explode("prefix").alias("h")).where("h IS NOT NULL")
    posts = posts.repartition("h").dropDuplicates(["class", "h"])  # one exchange, read by the count and by the join
    groups = posts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("class")).alias("members"), F.min("class").alias("lead"))
    shared = stored(posts.join(groups.where("m > 1"), "h"), "shared")
    one = shared.select("h", "m", "members", "lead").distinct().groupBy("m", "members", "lead").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("times"))
    if percent > 50:  # two sets that meet alone and once can't link
        one = one.where("m > 2 OR times > 1")
    many = F.sum("m").over(W.partitionBy("lead"))  # posts of all groups of a lead, a row a group
    one = one.withColumn("parts", F.ceil(many / (4 * CELL_ROWS)))
    one = stored(one.select("h", F.pmod(F.xxhash64("h"), "parts").alias("part")), "groups")
    posts = stored(shared.select("class", "h", "m", "lead").join(one, "h"), "kept")
    met = first.join(posts.select("class").distinct(), "class", "left_semi").select("class", "n", "bits")
    met = stored(met.dropDuplicates(["class"]), "met")
    posts = posts.withColumn("blocks", F.ceil(F.col("m") / GROUP).cast("int"))
    posts = posts.withColumn("blk", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")})
    # groups with the same smallest class have many members in common and lie in the same cells
    cells = max(64, -(-met.count() // CELL_ROWS))
    posts = posts.withColumn("cell", F.pmod(F.xxhash64("lead", "part", "bi", "bj"), F.lit(cells)))
    post = F.struct(F.xxhash64("h", "bi", "bj").alias("grp"), "blk", "bi", "bj")
    posts = stored(posts.groupBy("cell", "class").agg(F.collect_list(post).alias("posts")), "posts")

    def joined(posts: DataFrame, forest_only: bool) -> DataFrame:
        p = posts.join(met.select("class", "n", "bits"), "class")
        found = p.groupBy("cell").applyInArrow(joiner(percent, forest_only), "a long, b long")
        return stored(found.distinct(), "possible")

    checked = verified(joined(posts.withColumn("component", F.lit(0).cast("long")), True), rows, classes, shingle, percent)
    links = checked.where("linked").select("a", "b")
    failed = checked.where("NOT linked").select("a", "b")
    if failed.limit(1).count():
        tried = components(checked.select("a", "b")).withColumnRenamed("id", "class")
        suspect = failed.join(tried.withColumnRenamed("class", "a"), "a").select("component").distinct()
        suspects = tried.join(suspect, "component", "left_semi").select("class")
        linked = components(links).withColumnRenamed("id", "class")
        again = posts.join(suspects, "class", "left_semi").join(linked, "class", "left")
        again = again.withColumn("component", F.coalesce("component", "class"))
        more = joined(again, False).join(failed, ["a", "b"], "left_anti")
        more = verified(stored(more, "possible"), rows, classes, shingle, percent)
        links = links.unionByName(more.where("linked").select("a", "b"))
    links = links.join(classes.toDF("a", "u"), "a").join(classes.toDF("b", "v"), "b").select("u", "v")
    # an id with several texts, or with one and an empty one, is linked with the smallest id of each of its classes
    every = sets.where("id IS NOT NULL").groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = stored(every.where("low <> high").select("id"), "mixed")
    bound = some.select("id", "class").join(mixed, "id", "left_semi").distinct().join(classes, "class")
    near = stored(components(links.unionByName(bound.select(F.col("id").alias("u"), F.col("rep").alias("v"))), "u", "v"), "near")
    known = classes.join(near.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", "n", "class").join(known, "class", "left")
    empty = mixed.join(near, "id").select("id", F.col("component").alias("own"))  # rows without words have no class of their own
    out = out.join(empty, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "own", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op5_signature_trees(spark, sf_dir: str) -> DataFrame:
    return near_texts(documents(spark, sf_dir))
