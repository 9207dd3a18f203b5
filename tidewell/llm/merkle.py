"""A dataset manifest: every row a leaf of one hash tree, with an inclusion proof and a check of a (tampered) copy.

A leaf is the hash of the columns of a row, each ``-`` if null, else UTF-8 byte count, ``:`` and value. Leaves are kept
in groups (of one language, say) in the order of their ids; while a group has more than one node, every ``FAN``
consecutive ones become their hash. What remains is the group's subroot; the subroots in the order of the groups (null
first, then bytewise) become the root in the same way.

How it runs: places in a group are counted without one task seeing a whole group: distinct rows (with how often each
occurs) are sorted by range, the rows of each range are counted, and the counts of the ranges before it are added.
``FAN ** DEPTH`` consecutive leaves are a superblock. A first pass keeps only the top of each superblock; the few tops
climb to subroots and root level by level. Then leaves and the outer nodes that their proofs need are cogrouped by
superblock, which finishes the local reduction, joins the proofs and folds each row's copy up to the root.

Defined results: null ids come first in their group and count as the empty text for tampering. Rows of the same id are
ordered by their leaves; rows that are equal take places one after the other, so each has its own proof. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.durable import stored

from .common import documents, fold

FAN, DEPTH = 8, 4
BLOCK = FAN**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    texts = [c.cast("string") for c in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)), 256)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``first``: how many copies (column ``n``) lie before them in their group, in the given order.

    ``order`` has to tell rows of a group apart.
    """
    parts = rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "places")
    totals = parts.groupBy("part", group).agg(F.sum("n").alias("total"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    totals = totals.select("part", group, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return parts.join(totals, ["part", group]).withColumn("first", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (grp, pos, h, n) with n nodes in the group: (grp, pos, path) and (grp, top).

    ``path`` has for each level the own place in its run and the hashes of the whole run.
    """
    nodes = stored(nodes, "nodes")
    paths, tops, steps, now = nodes.select("grp", "pos"), nodes.where("n = 1").select("grp", "h"), [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = now.where("n > 1").groupBy("grp", F.expr(f"pos div {FAN}").alias("pos"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("run"), F.min(F.ceil(F.col("n") / FAN)).alias("n"))
        runs = stored(runs.select("grp", "pos", "n", F.col("run.h").alias("run")), "runs")
        width, name = FAN ** len(steps), f"step{len(steps)}"
        own = F.expr(f"cast(pmod(own div {width}, {FAN}) as int)")
        paths = paths.withColumnRenamed("pos", "own").withColumn("pos", F.expr(f"own div {width * FAN}"))
        paths = paths.join(runs.select("grp", "pos", "run"), ["grp", "pos"], "left")
        step = F.when(F.col("run").isNotNull(), F.struct(own.alias("own"), "run"))
        paths = paths.withColumn(name, step).drop("pos", "run").withColumnRenamed("own", "pos")
        steps.append(name)
        now = runs.select("grp", "pos", F.sha2(F.array_join("run", ""), 256).alias("h"), "n")
        tops = tops.unionByName(now.where("n = 1").select("grp", "h"))
        most = -(-most // FAN)
    none = F.expr("cast(array() as array<struct<own:int,run:array<string>>>)")
    path = F.filter(F.array(*steps), lambda x: x.isNotNull()) if steps else none
    return paths.select("grp", "pos", path.alias("path")), tops.withColumnRenamed("h", "top")


def reduced(leaves: list[str], alone: bool) -> list[list[str]]:
    """The levels of a superblock from its leaves to its top; the only block of a group ends as soon as one node is left."""
    levels = [leaves]
    while (len(levels[-1]) > 1) if alone else (len(levels) <= DEPTH):
        below = levels[-1]
        levels.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def tops_of(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    leaves = block.sort_values("pos")["leaf"].tolist()
    return pd.DataFrame([(*key, reduced(leaves, True)[-1][0], reduced(leaves, False)[-1][0])], columns=["grp", "block", "alone", "top"])


def finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs and folded roots of the leaves of a superblock; ``outer`` is the one row of its way to the root."""
    block = block.sort_values("pos")
    leaves, changed = block["leaf"].tolist(), block["tampered"].tolist()
    way = outer.iloc[0]
    levels = reduced(leaves, bool(way["alone"]))
    above = [(int(s["own"]), list(s["run"])) for s in [*way["path"], *way["root_path"]]]
    rest = "".join("".join(run[:own] + run[own + 1 :]) for own, run in above)
    out = []
    for i in range(len(leaves)):
        proof, at = [], i
        now = changed[i] if isinstance(changed[i], str) else leaves[i]
        for level in levels[:-1]:
            start, own = at - at % FAN, at % FAN
            run = level[start : start + FAN]
            proof += run[:own] + run[own + 1 :]
            run[own] = now
            now, at = digest(run), at // FAN
        for own, run in above:
            now = digest(run[:own] + [now] + run[own + 1 :])
        out.append((digest([*proof, rest]), now))
    proofs, folded = zip(*out, strict=True)
    done = pd.DataFrame({"id": block["id"].tolist(), "leaf": leaves, "subroot": way["subroot"], "root": way["root"]})
    return done.assign(proof_sha256=proofs, folded_root=folded, verified=[f == way["root"] for f in folded])


def manifest(docs: DataFrame, columns: tuple[str, ...], tampered: Column, changed: dict[str, Column], *, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Where ``tampered`` holds, the copy to be checked has the values of ``changed`` in place of the row's own.
    """
    own = [F.col(f"`{c}`") for c in columns]
    other = F.when(tampered, leaf([changed.get(c, F.col(f"`{c}`")) for c in columns]))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # "-" is before "="
    rows = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), leaf(own).alias("leaf"), other.alias("tampered"))
    rows = rows.groupBy("id", "grp", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))
    rows = placed(rows, "grp", [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tampered")])
    leaves = rows.select(F.col("id").cast("string").alias("id"), "grp", "leaf", "tampered", F.explode(F.sequence("first", F.expr("first + n - 1"))).alias("pos"))
    leaves = stored(leaves.withColumn("block", F.expr(f"pos div {BLOCK}")), "leaves")
    tops = leaves.select("grp", "block", "pos", "leaf").groupBy("grp", "block")
    tops = stored(tops.applyInPandas(tops_of, "grp string, block long, alone string, top string"), "tops")
    n = tops.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    nodes = tops.join(n, "grp").select("grp", F.col("block").alias("pos"), F.when(F.col("n") == 1, F.col("alone")).otherwise(F.col("top")).alias("h"), "n")
    paths, subroots = climb(nodes)
    subroots = stored(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("h"), F.lit(1).cast("long").alias("n")), "subroots")
    groups = placed(subroots, "grp", [F.col("name")]).withColumnRenamed("first", "pos")
    groups = stored(groups.select("name", "pos", "h"), "groups")
    count = groups.count()
    up, root = climb(groups.select(F.lit("").alias("grp"), "pos", "h", F.lit(count).cast("long").alias("n")))
    up = groups.join(up.drop("grp"), "pos").select(F.col("name").alias("grp"), F.col("h").alias("subroot"), F.col("path").alias("root_path"))
    top = root.first()  # one row, none for an empty table
    up = up.withColumn("root", F.lit(top["top"] if top else None).cast("string"))
    alone = n.select("grp", (F.col("n") == 1).alias("alone"))
    outer = paths.join(up, "grp").join(alone, "grp").withColumnRenamed("pos", "block")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = leaves.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(finish, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    lower = F.translate("text", UPPER, LOWER)
    return manifest(documents(spark, sf_dir), COLUMNS, fold("doc_id", 3) == 0, {"text": lower})


# --- the same in SQL, level by level

_LEVELS, _ROOT_LEVELS = 12, 4


def crc32_sql(text: str) -> str:
    """crc32 of a text in DuckDB, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT for i in range(8)]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    octets = f"[('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT for i in range(strlen({text}))]"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {bits}), 4294967295)"


def _level_sql(name: str, n: int) -> str:
    """Nodes and runs of the levels above ``{name}0`` (grp, pos, h, n)."""
    out = []
    for k in range(n):
        out.append(f"{name}r{k} AS (SELECT grp, pos // {FAN} AS pos, list(h ORDER BY pos) AS run, ceil(any_value(n) / {FAN})::BIGINT AS n FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT grp, pos, sha256(array_to_string(run, '')) AS h, n FROM {name}r{k})")
    tops = " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE n = 1" for k in range(n + 1))
    return ",\n".join([*out, f"{name}tops AS ({tops})"])


def _fold_sql(source: str, name: str, n: int, to: str) -> str:
    """Rows of ``source`` with (grp, pos, now, proof) go up the levels of ``name``."""
    out, at = [], source
    for k in range(n):
        out.append(
            f"{to}{k} AS (SELECT s.* REPLACE (s.pos // {FAN} AS pos,"
            f" CASE WHEN r.run IS NULL THEN s.now ELSE sha256(array_to_string([CASE WHEN i = s.pos % {FAN} + 1 THEN s.now ELSE r.run[i] END for i in range(1, len(r.run) + 1)], '')) END AS now,"
            f" CASE WHEN r.run IS NULL THEN s.proof ELSE s.proof || array_to_string([r.run[i] for i in range(1, len(r.run) + 1) if i <> s.pos % {FAN} + 1], '') END AS proof)"
            f" FROM {at} s LEFT JOIN {name}r{k} r ON r.grp = s.grp AND r.pos = s.pos // {FAN})"
        )
        at = f"{to}{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    parts = [text if c == "text" else f"{c}::VARCHAR" for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


OP13_SQL = f"""
WITH made AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM made),
a0 AS (SELECT grp, pos, leaf AS h, n FROM l),
{_level_sql("a", _LEVELS)},
s AS (SELECT grp AS name, '' AS grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM atops),
b0 AS (SELECT grp, pos, h, n FROM s),
{_level_sql("b", _ROOT_LEVELS)},
f AS (SELECT doc_id, leaf, grp, pos, coalesce(tampered, leaf) AS now, '' AS proof FROM l),
{_fold_sql("f", "a", _LEVELS, "u")},
g AS (SELECT u.doc_id, u.leaf, s.h AS subroot, s.grp, s.pos, u.now, u.proof FROM u{_LEVELS - 1} u JOIN s ON s.name = u.grp),
{_fold_sql("g", "b", _ROOT_LEVELS, "v")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified
FROM v{_ROOT_LEVELS - 1}, (SELECT h FROM btops)
"""
