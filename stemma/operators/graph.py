"""Graph operators over edge tables (src, dst), premise to conclusion. Loops cut their lineage each turn and stop at a fixpoint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import cut, ship, some

#: Rows from which on a side of a loop's joins is not sent through the driver, whatever it would save.
FEW = 1 << 17


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ancestors of the seeds (id and keys), themselves included: keys, id, depth (of the shortest path).

    Only the frontier is joined with the edges. keys carry the origin, so many closures run as one. keep drops rows (keys, id) of a
    new frontier that need not be followed.
    """
    keys = list(keys)
    step = (edges if hasattr(edges, "stemma_path") else cut(edges.select("src", "dst"), "steps")).select(F.col("dst").alias("id"), F.col("src").alias("__up"))
    frontier = cut(seeds.select(*keys, "id").distinct(), "frontier")
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    n = total = frontier.count()
    for turn in count():  # each turn adds nodes or ends
        # several steps are one job; more of them, the longer the paths turn out to be
        hops, at, found = min(8, 2 + turn // 4), frontier, []
        up = step.hint("merge") if n > FEW else step
        for hop in range(1, hops + 1):
            at = at.join(up, "id").select(*keys, F.col("__up").alias("id")).distinct()
            at = keep(at) if keep else at
            found.append(at.withColumn("depth", F.lit(depth + hop)))
        depth += hops
        new = reduce(DataFrame.unionByName, found).groupBy(*keys, "id").agg(F.min("depth").alias("depth"))
        old = seen.hint("merge") if total > FEW else seen
        new = cut(new.join(old, [*keys, "id"], "left_anti").select(*keys, "id", "depth"), "frontier")
        seen = seen.unionByName(new)
        frontier = new.where(F.col("depth") == depth).drop("depth")
        more, n = new.agg(F.count(F.lit(1)), F.count_if(F.col("depth") == depth)).first()
        total += more
        if not n:
            return seen
        if turn % 8 == 7:
            seen = cut(seen, "seen")


def descendants(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return closure(reverse(edges), seeds, keys)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds (id) and all that is below them, for few seeds or most of the graph, without depths.

    An edge into what was reached leads to nothing new. Edges are written anew without those once a fourth of them may go, so turns
    get shorter, and only what was found since then is joined: a turn's plan, which the driver makes and compiles, stays small.
    """
    seen = frontier = since = cut(seeds.select("id").distinct(), "frontier")
    left, rows = edges.select("src", "dst"), 0
    n = many = frontier.count()
    for turn in count():  # each turn adds nodes or ends
        if not n:
            return seen.distinct()
        if 4 * many >= rows:
            gone = since.withColumnRenamed("id", "dst")
            left = cut(left.join(gone.hint("merge") if many > FEW else gone, "dst", "left_anti").select("src", "dst"), "left")
            rows, many, since = left.count(), 0, None
            if not rows:
                return seen.distinct()
        # several steps are one job only where few are to be followed: what many reach is taken off the edges at once
        hops, at, found = 1 if n > FEW else min(8, 2 + turn // 4), frontier, []
        for hop in range(hops):
            down = left.hint("merge") if rows > FEW and n > FEW >> 2 * hop else left  # a later step may find several times as many
            at = at.join(down.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id")).distinct()
            found.append(at.withColumn("hop", F.lit(hop)))
        new = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("hop").alias("hop"))
        if since is not None:
            new = new.join(since.hint("merge") if many > FEW else since, "id", "left_anti")
        new = cut(new.select("id", "hop"), "frontier")
        more, n = new.agg(F.count(F.lit(1)), F.count_if(F.col("hop") == hops - 1)).first()
        frontier, added = new.where(F.col("hop") == hops - 1).select("id"), new.select("id")
        seen, since, many = seen.unionByName(added), added if since is None else since.unionByName(added), many + more
        if turn % 8 == 7:
            seen = cut(seen, "seen")
            since = since if since is None else cut(since, "since")


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, level) of the nodes that come off in topological order, level being the longest path to them, and the
    residue (id): nodes in cycles and below them. Nodes that only edges name count as well; missing ids and edges without an end don't."""
    nodes, edges = nodes.where("id is not null"), edges.where("src is not null and dst is not null")
    left = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id")))
    left, edges, done = cut(left.distinct(), "left"), cut(edges.select("src", "dst").distinct(), "edges"), None
    for level in count():  # each turn takes nodes off or ends
        ready = cut(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"), "ready")
        if not some(ready):
            return (done if done is not None else ready.withColumn("level", F.lit(0))), left
        now = ready.withColumn("level", F.lit(level))
        done = now if done is None else done.unionByName(now)
        left = left.join(ready, "id", "left_anti")
        edges = edges.join(ready.withColumnRenamed("id", "src"), "src", "left_anti")
        if level % 3 == 2:
            left, edges = cut(left, "left"), cut(edges, "edges")
        if level % 16 == 15:
            done = cut(done, "done")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    out = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def redundant_edges(edges: DataFrame) -> DataFrame:
    """Edges u -> v for which another path from u to v exists. For views only: nothing is deleted.

    A path to u leads through nodes of higher levels than u's alone, so the search from the other premises of v stops at u's level; in
    cycles, where nodes have no level, nothing is left out.
    """
    edges = cut(edges.select("src", "dst").distinct(), "distinct-edges")
    # an edge from a node without premises of its own whose conclusion has one premise alone can't be passed by
    several = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dst")
    via = edges.join(several, "dst", "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("target"))
    levels = cut(peel(edges.select(F.col("src").alias("id")).distinct(), edges)[0], "levels")
    low = levels.select(F.col("id").alias("u"), F.col("level").alias("floor"))
    own = levels.select("id", "level")

    def above(rows: DataFrame) -> DataFrame:
        near = rows.join(low, "u", "left").join(own, "id", "left")
        return near.where("id = u or floor is null or level is null or level > floor").select(*rows.columns)

    # the other premises of each edge's conclusion, and all that is above them
    others = above(via.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("target")), "target").where("id <> u").select("u", "target", "id"))
    found = closure(edges, others, ("u", "target"), above)
    return found.where("id = u").select(F.col("u").alias("src"), F.col("target").alias("dst")).distinct()


def closure_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, size of each node's closure, itself included."""
    found = closure(edges, nodes.select(F.col("id").alias("target"), "id"), ("target",))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("target", "id")


def preferred(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """owner, id, size: per owner the node with the largest closure, the smallest id of equals."""
    rank = Window.partitionBy("owner").orderBy(F.col("size").desc(), "id")
    sized = nodes.select("id", "owner").hint("merge").join(closure_sizes(edges, nodes), "id")
    return sized.withColumn("k", F.row_number().over(rank)).where("k = 1").select("owner", "id", "size")


def reachable_blocked(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Nodes that may not pass as accepted, as something blocked is above them."""
    return reachable(edges, blocked)


def assemble(candidates: DataFrame, graph: str = "graph") -> DataFrame:
    """Greedy assembly of acyclic graphs from scored edges (graph, src, dst, score): graph, src, dst, accepted, reason.

    One graph is one sequential decision, so each goes to one task; graphs run side by side.
    """

    def grow(pdf):
        import pandas as pd

        up: dict = {}

        def reaches(a, b) -> bool:
            stack, seen = [a], set()
            while stack:
                x = stack.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    stack.extend(up.get(x, ()))
            return False

        out = []
        for r in pdf.sort_values(["score", "src", "dst"], ascending=[False, True, True]).itertuples(index=False):
            reason = "self loop" if r.src == r.dst else "duplicate" if r.src in up.get(r.dst, ()) else "cycle" if reaches(r.src, r.dst) else None
            if reason is None:
                up.setdefault(r.dst, set()).add(r.src)
            out.append((getattr(r, graph), r.src, r.dst, reason is None, reason))
        return pd.DataFrame(out, columns=[graph, "src", "dst", "accepted", "reason"])

    ship(candidates.sparkSession)
    kind = dict(candidates.dtypes)
    return candidates.groupBy(graph).applyInPandas(grow, f"{graph} {kind[graph]}, src {kind['src']}, dst {kind['dst']}, accepted boolean, reason string")
