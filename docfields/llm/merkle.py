"""Merkle manifest of a dataset by slot pivots.

Rows are leaves; the leaves of a group form a tree, in the order of their id;
the groups' roots are the leaves of a last tree, in the order of the group.
While a tree has several nodes, every ``fanout`` consecutive ones (the last run
may be shorter) become one node, the hash of their digests.

A pivot makes one row of every ``fanout ** k`` consecutive nodes: conditional
aggregates spread a parent's children into slot columns (combined before the
shuffle, so little more than the finished rows moves). Concatenating the columns
of a parent's children hashes it, and hashing on gives the row's k levels;
leaving out a child's own column gives its siblings. Runs are short, so neither
a large group nor a single tree meets in one task, and ten pivots reach the root
of 10^11 leaves. Proofs come back down: a pivot row joined with the path of its
topmost node has the paths of all its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import saved

#: Slot columns of a pivot row, at most (a level has ``fanout`` in any case).
SLOTS = 16
#: What a path holds for one level: the digests before and after the own one.
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value as the leaf hash takes it: ``-`` if null, else its bytes, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``tree, pos, n``: the group's place among all groups (null
    first, strings by their bytes), the row's place in its group in ``order``
    (nulls first, should end in something unique), and the rows of the group.

    One range sort; a row's number within its task, and one count per task and
    group, give the places by windows over tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()),
                   f"{name}-ranged")
    part = F.shiftright("_row", 33)  # the task's number, as Spark documents it
    counts = saved(ranged.groupBy(part.alias("_part"), F.col(group).alias("_group"))
                         .agg(F.min("_row").alias("_first"), F.count("*").alias("_rows")), f"{name}-counts")
    inside = Window.partitionBy("_group")
    before = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.sum("_rows").over(inside).alias("n"), F.min("_part").over(inside).alias("_at"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # groups that begin in one task follow each other there; tasks before count for all of theirs
    begun = counts.where("_part = _at")
    earlier = (begun.groupBy("_at").agg(F.count("*").alias("_groups"))
                    .select("_at", F.coalesce(F.sum("_groups").over(
                        Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_groups")))
    trees = (begun.select("_group", "_at", F.row_number().over(Window.partitionBy("_at").orderBy("_first")).alias("_nth"))
                  .join(earlier, "_at").select(F.col("_group").alias("_g"), (F.col("_groups") + F.col("_nth") - 1).alias("tree")))
    places = saved(counts.join(trees, F.col("_group").eqNullSafe(F.col("_g")))
                         .select("_part", "_group", "tree", "n", (F.col("_before") - F.col("_first")).alias("_shift")), f"{name}-places")
    return (ranged.join(places, (part == places["_part"]) & F.col(group).eqNullSafe(places["_group"]))
                  .select(*df.columns, "tree", (F.col("_row") + F.col("_shift")).alias("pos"), "n"))


class Forest:
    """The trees over ``nodes`` (``tree, pos, n, digest`` and the ``carried``
    columns): pivot rows of every step, and ``roots`` (``tree, digest``)."""

    def __init__(self, nodes: DataFrame, fanout: int, name: str, carried: tuple[str, ...] = ()):
        if fanout < 2:
            raise ValueError("a parent has at least two children")
        self.fanout, self.depth = fanout, 1
        while fanout ** (self.depth + 1) <= SLOTS:
            self.depth += 1
        self.slots = fanout ** self.depth
        self.rows: list[DataFrame] = []
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1 or not self.rows:
            self.rows.append(saved(self._pivot(nodes, () if self.rows else carried), f"{name}-pivot"))
            top = self._levels(self.rows[-1])
            nodes = top.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / self.slots).alias("n"),
                               F.col(f"x{self.depth}_0").alias("digest"))
            most = -(-most // self.slots)
        self.roots = saved(nodes.select("tree", "digest"), f"{name}-roots")

    def _pivot(self, nodes: DataFrame, carried: tuple[str, ...]) -> DataFrame:
        """One row for each run of ``slots`` nodes, its nodes in columns ``c0, c1, ...``."""
        node = f"struct({', '.join(['digest', *carried])})"
        picks = [F.expr(f"max(CASE WHEN pos % {self.slots} = {j} THEN {node} END) AS c{j}") for j in range(self.slots)]
        block = F.expr(f"pos div {self.slots} AS block")
        return nodes.select("*", block).groupBy("tree", "block").agg(F.max("n").alias("n"), *picks)

    def _levels(self, rows: DataFrame) -> DataFrame:
        """Columns ``x{level}_{i}``: the digests of all levels of a row. A tree
        that has one node left stays as it is."""
        rows = rows.selectExpr("*", *[f"c{j}.digest AS x0_{j}" for j in range(self.slots)])
        for level in range(self.depth):
            grown = []
            for i in range(self.slots // self.fanout ** (level + 1)):
                children = [f"x{level}_{i * self.fanout + j}" for j in range(self.fanout)]
                hashed = f"CASE WHEN n > {self.fanout ** level} THEN sha2(concat_ws('', {', '.join(children)}), 256) END"
                grown.append(f"CASE WHEN {children[0]} IS NOT NULL THEN coalesce({hashed}, {children[0]}) END AS x{level + 1}_{i}")
            rows = rows.selectExpr("*", *grown)
        return rows

    def _slot(self, j: int) -> str:
        """A slot's node and its path within the row: level by level, what its
        run's other columns hold. Null where the slot is empty."""
        steps = []
        for level in range(self.depth):
            own = j // self.fanout ** level
            run = own - own % self.fanout
            before, after = (", ".join(["''", *[f"x{level}_{i}" for i in range(*span)]])
                             for span in ((run, own), (own + 1, run + self.fanout)))
            steps.append(f"CASE WHEN n > {self.fanout ** level} THEN "
                         f"named_struct('l', concat_ws('', {before}), 'r', concat_ws('', {after})) END")
        path = f"array_compact(array({', '.join(steps)}))"
        return f"CASE WHEN c{j} IS NOT NULL THEN named_struct('j', {j}, 'node', c{j}, 'path', {path}) END"

    def paths(self, above: DataFrame, *kept: str) -> DataFrame:
        """``tree, pos, digest``, the carried columns, ``path`` and the ``kept``
        columns of every leaf; ``above``: ``tree, path`` and ``kept`` of every tree."""
        above = above.withColumn("pos", F.lit(0).cast("long"))
        for rows in reversed(self.rows):
            over = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *kept)
            joined = self._levels(rows.join(over, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_pos"))))
            slots = F.expr(f"explode(array_compact(array({', '.join(map(self._slot, range(self.slots)))}))) AS s")
            above = (joined.select("tree", "block", "_path", *kept, slots)
                           .select("tree", (F.col("block") * self.slots + F.col("s.j")).alias("pos"), "s.node.*",
                                   F.concat("s.path", "_path").alias("path"), *kept))
        return above


def manifest(rows: DataFrame, fields: tuple[str, ...], group: str, order: str, fanout: int = 2,
             altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``order, leaf, subroot, root, path, proof_sha256, folded_root, verified``
    of every row.

    A leaf is the hash of the row's ``fields``; the leaves of a ``group`` ascend
    by ``order`` and then by their digest; groups ascend by their bytes, null
    first. ``path`` has the siblings of each level up to the root, and
    ``proof_sha256`` is the hash of them all. Rows for which ``where`` holds are
    tampered with: ``altered`` gives the changed values of fields, from which
    ``folded_root`` is recomputed with the original siblings; of other rows it
    is recomputed from what they are. ``verified``: it equals the root.

    Null values are hashed as such, and a null ``order`` comes first; repeated
    rows are leaves of their own, side by side; a table of one row has that
    leaf as its root, with an empty path; an empty table gives no rows. Other
    columns are not looked at.
    """
    value = {f: F.col(f"`{f}`") for f in fields}
    changed = F.lit(None).cast("string") if where is None else F.when(where, leaf_hash(*(value | (altered or {})).values()))
    leaves = saved(rows.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("id"),
                               leaf_hash(*value.values()).alias("digest"), changed.alias("changed"),
                               F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    nodes = numbered(leaves, "grp", ["id", "digest", "tie"], "merkle")
    forest = Forest(nodes, fanout, "merkle", ("id", "changed"))
    groups = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                 F.lit(forest.roots.count()).cast("long").alias("n"), "digest")
    last = Forest(groups, fanout, "merkle-top")
    top = last.roots.select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    subroots = last.paths(top, "root").select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    found = forest.paths(saved(subroots, "merkle-subroots"), "subroot", "root")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "digest"),
                         lambda done, s: F.sha2(F.concat(s["l"], done, s["r"]), 256))
    return (found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path",
                         F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
                 .withColumn("verified", F.col("folded_root") == F.col("root")))
