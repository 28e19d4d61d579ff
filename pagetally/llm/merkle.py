"""Merkle manifest of a table: a digest for each row, each group and the whole, and each row's proof.

A row's leaf is the digest of its fields; a group's leaves stand in the order of ids. While a group has several
nodes, every ``fan`` consecutive ones become their parent, the digest of their digests' hex text; the last run
may have fewer. The one left is the group's subroot (a lone leaf itself), and the subroots, in the order of their
groups, make the root in the same way.

1. *Leaves.* Texts are read once and digested; from here on a row is its id, group and digests, kept in a checkpoint.
2. *Places.* ``ranked`` numbers a group's leaves over all tasks, so a group with most rows is no task of its own.
3. *Levels.* A level is a window: partitioned by group and parent index, in the order of places, over its whole frame.
   ``collect_list`` there is the parent's preimage and holds the node's siblings. Of each parent's rows only the first
   stands for it in the next level (the others give null, which is not collected). ``height`` levels need one shuffle,
   by blocks of fan ** height leaves, and one sort: coarser parents come first in the sort order. Then each block is
   one row, its parents without copies, and the next levels begin with these.
4. *Proofs.* Siblings of upper levels come down block by block; a block has at most fan ** height rows.

Defined results: H is SHA-256 in lowercase hex of the inputs' concatenation, a field being "-" if null, else its UTF-8
byte count, ":" and its value, so an empty text (0:) differs from a null one. A null group is a group, the first one; a
row without id comes first in its group; rows with one id stand in the order of their leaves, equal rows each have a
place and a proof of their own. A text of any length is digested whole. Further columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.llm.common import checkpointed
from pagetally.operators.ranks import ranked

PATH = "array<struct<left: string, right: string>>"


def digest(values: list[Column]) -> Column:
    """H of fields."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def _levels(nodes: DataFrame, fan: int, height: int, below: int) -> DataFrame:
    """nodes (g, pos, n, h, ...): pos counts a group's nodes ``below`` levels over its n leaves. Adds block, path
    (siblings in so many levels), and h becomes the node that ``height`` levels end in."""
    ancestors = [F.expr(f"pos div {fan**j}L").alias(f"a{j}") for j in range(1, height)]
    rows = nodes.select("*", F.expr(f"pos div {fan**height}L").alias("block"), F.array().cast(PATH).alias("path"), *ancestors).repartition("g", "block")
    keys = ["g", "block", *[f"a{j}" for j in range(height - 1, 0, -1)], "pos"]
    for j in range(height):
        many = F.col("n") > fan ** (below + j)
        split = len(keys) - j - 1
        run = Window.partitionBy(*keys[:split]).orderBy(*keys[split:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list(F.when(F.col("pos") % fan**j == 0, F.col("h"))).over(run))
        own = F.expr(f"CAST((pos div {fan**j}L) % {fan} AS INT)")
        level = F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("left"), F.array_join(F.slice("run", own + 2, F.lit(fan)), "").alias("right"))
        path, parent = F.array_append("path", level), F.sha2(F.array_join("run", ""), 256)
        rows = rows.withColumns({"path": F.when(many, path).otherwise(F.col("path")), "h": F.when(many, parent).otherwise(F.col("h"))})
    return rows.drop("run", *keys[2:-1])


def _climb(leaves: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels of each round, one row for each group with its top h)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    tables, nodes, below = [], leaves, 0
    while not tables or fan**below < most:
        step = next((k for k in range(1, height) if fan ** (below + k) >= most), height)
        tables.append(checkpointed(_levels(nodes, fan, step, below)))
        nodes = tables[-1].where(F.col("pos") % fan**step == 0).select("g", F.col("block").alias("pos"), "n", "h")
        below += step
    return tables, nodes


def _descend(tables: list[DataFrame], upper: DataFrame) -> DataFrame:
    """upper (g, pos, path, more columns): what each group's top is followed by. The lowest round's rows with whole paths."""
    for rows in reversed(tables):
        above = upper.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *[c for c in upper.columns if c not in ("g", "pos", "path")])
        met = rows.join(above, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_pos")))
        upper = met.withColumn("path", F.concat("path", "_path")).drop("_g", "_pos", "_path", "block", "n", "h")
    return upper


def merkle_manifest(docs: DataFrame, fields: list[str], group: str, id_col: str = "doc_id", fan: int = 2, height: int = 10, presented: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, path, presented_leaf): path has the siblings of each level, those left and those
    right of the node; ``fold(presented_leaf, path)`` is the root if the row is as it was. ``presented`` gives fields'
    values (columns over docs) at the time of the check; without it they are those of the manifest."""
    if fan < 2 or height < 1:
        raise ValueError("a parent needs two children, and a round one level")
    leaf = digest([F.col(f) for f in fields])
    other = F.lit(False)
    for name, value in (presented or {}).items():
        other = other | ~value.cast("string").eqNullSafe(F.col(name).cast("string"))
    then = F.when(other, digest([(presented or {}).get(f, F.col(f)) for f in fields]))
    leaves = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(group).alias("g"), leaf.alias("h"), then.alias("then")))
    placed = ranked(leaves, ["g"], [F.col("id").asc_nulls_first(), F.col("h").asc()])
    placed = placed.withColumnsRenamed({"rank": "pos", "total": "n"}).withColumn("leaf", F.col("h"))
    tables, tops = _climb(placed, fan, height)
    tops = ranked(tops.select("g", F.col("h").alias("subroot")), [], [F.col("g").asc_nulls_first()])
    above, root = _climb(tops.select(F.lit(0).alias("g"), F.col("rank").alias("pos"), F.col("total").alias("n"), F.col("subroot").alias("h"), F.col("g").alias("named"), "subroot"), fan, height)
    whole = root.select("g", "pos", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    groups = _descend(above, whole).select(F.col("named").alias("g"), F.lit(0).alias("pos"), "path", "root", "subroot")
    out = _descend(tables, groups)
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "path", F.coalesce("then", "leaf").alias("presented_leaf"))
