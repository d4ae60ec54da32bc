"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Slot pivot: conditional aggregates spread the children of a parent into one column for each slot; the columns in a row,
hashed, are the parent, and those in a row without a child's own are its siblings. Several levels go in one aggregation:
a block of ``fanout ** levels`` neighbours becomes one row of that many slot columns, from which the levels between are
worked out by the same rule, so a tree of n leaves takes log(n) / levels shuffles.

Proofs come from the top down: a block's row gets the steps above its root and hands them to its children, each with its
own steps in the block before them. The long lists of steps exist for blocks only; the leaves' own are made in the last pass.

Leaves are placed by a sort over all rows (``ranked``), not by a window for each group, and equal rows go to many tasks.

Defined results: null values are hashed as such; rows equal in group and order stand by their leaf's digest; a null value of
the order comes first, as does the group null; equal rows are leaves of their own; a group of one row has its leaf as root;
columns besides the fields are not looked at; values of any length are hashed whole; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 4


def digest(*parts: Column) -> Column:
    """The hex SHA-256 of the parts in a row; nulls add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(values: list[Column]) -> Column:
    """A row's digest: each value as its length in bytes, a colon, and its text; a null as a minus sign."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """g, n (nodes of g on this level), pos, slots (what stands in each), l0, l1, ... (digests by level), root.

    nodes: g, n, pos, node (with its digest).
    """
    width = fanout**levels
    spread = [F.any_value(F.when(F.col("pos") % width == j, F.col("node")), ignoreNulls=True).alias(f"s{j}") for j in range(width)]
    out = nodes.groupBy("g", "n", F.expr(f"pos div {width}").alias("pos")).agg(*spread)
    out = out.select("g", "n", "pos", F.array(*[f"s{j}" for j in range(width)]).alias("slots"), *[F.col(f"s{j}.digest").alias(f"d0_{j}") for j in range(width)])
    for t in range(1, levels + 1):
        run = lambda j, t=t: [F.col(f"d{t - 1}_{i}") for i in range(j * fanout, (j + 1) * fanout)]
        out = out.select("*", *[F.when(run(j)[0].isNotNull(), digest(*run(j))).alias(f"d{t}_{j}") for j in range(fanout ** (levels - t))])
    height = reduce(lambda a, b: a + b, [(F.col("n") > fanout**t).cast("int") for t in range(levels)])
    rows = [F.array(*[f"d{t}_{j}" for j in range(fanout ** (levels - t))]).alias(f"l{t}") for t in range(levels)]
    root = F.element_at(F.array(*[f"d{t}_0" for t in range(levels + 1)]), height + 1)
    return out.select("g", "n", "pos", "slots", *rows, height.alias("height"), root.alias("root"))


def _climb(nodes: DataFrame, most: int, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, written out, and g, root of each tree; most: the nodes of the largest."""
    width, rounds = fanout**levels, []
    while True:
        rounds.append(materialise(_blocks(nodes, fanout, levels)))
        nodes = rounds[-1].select("g", F.expr(f"(n + {width - 1}) div {width}").alias("n"), "pos", F.struct(F.col("root").alias("digest")).alias("node"))
        most = -(-most // width)
        if most <= 1:
            return rounds, rounds[-1].select("g", "root")


def _descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """g, node and path (left and right siblings, from the node up) of every first node; tops: g, path above the root, and more."""
    width, more = fanout**levels, [c for c in tops.columns if c not in ("g", "path")]
    paths = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in reversed(range(len(rounds))):
        each = rounds[k].join(paths, ["g", "pos"]).select("*", F.posexplode("slots").alias("j", "node")).where("node IS NOT NULL")
        steps = []
        for t in range(levels):
            own, first = f"j div {fanout**t}", f"(j div {fanout ** (t + 1)}) * {fanout}"
            side = lambda start, n, t=t: f"array_join(slice(l{t}, CAST({start} AS INT), CAST({n} AS INT)), '')"
            steps.append(F.expr(f"struct({side(f'{first} + 1', f'{own} - {first}')} AS before, {side(f'{own} + 2', f'{first} + {fanout - 1} - {own}')} AS after)"))
        path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("height")), "path")
        paths = each.select("g", *more, path.alias("path"), (F.col("pos") * width + F.col("j")).alias("pos"), *([] if k else ["node"]))
        paths = materialise(paths) if k else paths
    return paths


def manifest(leaves: DataFrame, *, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """leaf, row, subroot, root, proof of every row of leaves (group, order, leaf, row).

    A proof has a step for each level up to the root: the siblings before and after.
    """
    first = materialise(leaves)
    groups = materialise(ranked(first.groupBy("group").agg(F.count("*").alias("n")), [], [F.asc_nulls_first("group")]))
    most, trees = groups.agg(F.max("n"), F.count("*")).first()
    named = few(groups.select(F.col("group").alias("of"), "n", F.col("number").alias("g")))
    placed = ranked(first, ["group"], [F.asc_nulls_first("order"), F.asc("leaf")]).withColumnRenamed("number", "pos")
    nodes = placed.join(named, F.col("group").eqNullSafe(F.col("of"))).select("g", "n", "pos", F.struct(F.col("leaf").alias("digest"), "row").alias("node"))
    rounds, subroots = _climb(nodes, most or 0, fanout, levels)
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(trees).cast("long").alias("n"), F.col("g").alias("pos"), F.struct(F.col("root").alias("digest"), "g").alias("node"))
    above, root = _climb(tops, trees, fanout, levels)
    root = (root.first() or {"root": None})["root"]
    start = above[-1].select("g", F.array().cast("array<struct<before:string,after:string>>").alias("path")).distinct()
    tops = _descend(above, start, fanout, levels).select("node.g", "path", F.col("node.digest").alias("subroot"))
    return _descend(rounds, materialise(tops), fanout, levels).select(
        F.col("node.digest").alias("leaf"), "node.row", "subroot", F.lit(root).cast("string").alias("root"), F.col("path").alias("proof")
    )


def siblings(proof: Column) -> Column:
    """All siblings of a proof in a row."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def verify(docs: DataFrame, changed: Column, *, fields: tuple[str, ...] = FIELDS, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, where changed rows have one more in n_chars.

    All but the last two are of the rows as they are.
    """
    other = leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields])
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), leaf([F.col(f) for f in fields]).alias("leaf"), F.struct("doc_id", F.when(changed, other).alias("changed")).alias("row"))
    done = manifest(rows, fanout=fanout, levels=levels)
    again = folded(F.coalesce("row.changed", "leaf"), F.col("proof"))
    done = done.select("row.doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
