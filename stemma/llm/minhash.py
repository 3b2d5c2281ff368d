"""MinHash near-dedup by bottom-k sketches from one hash function.

A text's sketch is the SKETCH smallest hashes of its shingles. Equal sets are one class. Inverted lists of retained
values give the pairs that may overlap enough: of its sketch, ordered by how many classes retain a value, rarest
first, a class enters only the lists of as many values as must hold one that it shares with any class it is
similar to. Values that nobody else retains give no list. The union of two sketches estimates the similarity
of a pair; those that may pass are verified on full sets.

Lists may be long: a third of all texts can be near copies of one. So a list is never expanded into its pairs. Each
compares its members with its most central one, whose retained values are the most popular: near copies of one text
meet there. What is linked then is one component. Of lists that still hold several components, those around the same
central text are one cluster, and its members outside the central component are compared with all its members in
blocks: a task holds two blocks, filters their pairs by the same estimate, verifies on full sets, and gives only links that
join two components. Blocks are small and dealt in turn, so that no task gets much more than another.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import bound_arrow, discard, fresh, materialize
from stemma.llm.components import components
from stemma.llm.shingles import shingle_set

#: Words of a shingle, per cent of similarity, retained hashes.
WIDTH, PERCENT, SKETCH = 4, 80, 128
#: Of a full sketch, the share that similar texts share but with a chance under 1e-6: five deviations below 80 %.
SURE = 0.625
#: Estimates from full sketches may be so much too low, five deviations; from whole sets they are exact.
MARGIN = 0.19
#: Texts and shingles of one block.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1 << 19
#: Pairs of one pivot that one task is meant to take, and the least number of tasks that a pivot's pairs are dealt to.
SALT_PAIRS, SALTS = 1 << 14, 64


def node_of(shingles: np.ndarray) -> int | None:
    """The class of a text: a hash of its set; None without a shingle."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1 if len(shingles) else None


def sketch_batches(batches, width: int, size: int):
    for batch in batches:
        n, node, sketches = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width)
            n.append(len(s))
            node.append(node_of(s))
            sketches.append(s[:size])
        ends = pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sketches, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), values], names=["doc_id", "n_shingles", "node", "sketch"])


def set_batches(batches, width: int):
    """Class and set of each text; a task gives a class once."""
    seen: set[int] = set()
    for batch in batches:
        nodes, sets = [], []
        for text in batch.column(0).to_pylist():
            own = shingle_set(text, width)
            node = node_of(own)
            if node is not None and node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(own)
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), values], names=["node", "data"])


def estimate(a: np.ndarray, b: np.ndarray, percent: int, size: int, margin: float) -> bool:
    """Whether the sketch of the union lets the two be similar enough."""
    if len(a) < size and len(b) < size:  # both are whole sets
        return exact(a, b, percent, size, margin)
    return bool(estimates(a, [b], percent, size, margin)[0])


def estimates(a: np.ndarray, others: list[np.ndarray], percent: int, size: int, margin: float) -> np.ndarray:
    """The same for several b at once, some sketch being full: of the smallest values of each union, the share that both have."""
    rows = np.full((len(others), 2 * size), np.iinfo(np.int64).max)
    rows[:, : len(a)] = a
    for k, b in enumerate(others):
        rows[k, size : size + len(b)] = b
    rows.sort(axis=1)
    real = rows < np.iinfo(np.int64).max
    twice = (rows[:, 1:] == rows[:, :-1]) & real[:, 1:]
    new = np.concatenate([real[:, :1], real[:, 1:] & ~twice], axis=1)
    rank = np.cumsum(new, axis=1)
    both = (twice & (rank[:, 1:] <= size)).sum(axis=1)
    return 100 * both >= (percent - 100 * margin) * np.minimum(rank[:, -1], size)


def exact(a: np.ndarray, b: np.ndarray, percent: int, size: int, margin: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def meet_batches(batches, passes, percent: int, size: int, margin: float):
    """Rows come by (a, salt), the pivot's own first: each other is held against it."""
    at = held = None
    for batch in batches:
        out = []
        data = batch.column(3)
        flat, ends = data.values.to_numpy(), data.offsets.to_numpy()
        for k, (a, b, salt) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            own = flat[ends[k] : ends[k + 1]]
            if b is None:
                at, held = (a, salt), own.copy()
            elif at == (a, salt) and passes(held, own, percent, size, margin):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def meet(pairs: DataFrame, data: DataFrame, passes, percent: int, size: int, margin: float, tag: str) -> DataFrame:
    """The pairs (a, b) whose data (node, data) pass. The data of a go once to each salt, however many pairs a has."""
    # the pivot of all pairs, if there is but one, still leaves SALT_PAIRS to each salt
    salts = max(SALTS, pairs.count() // SALT_PAIRS)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    others = salted.join(data.withColumnRenamed("node", "b"), "b").select("a", "b", "salt", "data")
    pivots = salted.select("a", "salt").distinct().join(data.withColumnRenamed("node", "a"), "a")
    rows = pivots.select("a", F.lit(None).cast("long").alias("b"), "salt", "data").unionByName(others)
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(dealt.mapInArrow(partial(meet_batches, passes=passes, percent=percent, size=size, margin=margin), "a long, b long"), tag)


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & n.isNotNull()


def lists_of(classes: DataFrame, percent: int, size: int, share: float) -> DataFrame:
    """v, node, n, score: the inverted lists that classes must enter, without those of one member."""
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    often = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "list-sizes")
    found = values.join(often, "v").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("l"))
    held = F.least("n", F.lit(size))
    # where partners may be larger than a sketch, the chance bound holds; below, the sketch is the set, and the bound is exact
    sure = F.when(F.col("n") * 100 <= size * percent, F.ceil(held * percent / 100)).otherwise(F.floor(held * share)).cast("long")
    enter = held - sure + 1 - (held - F.size("l"))  # the values that only this class retains come first
    found = found.withColumn("enter", enter.cast("int")).where("enter > 0")
    score = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    common = F.transform("l", lambda x: x["v"])
    return found.select(F.explode(F.slice(common, F.lit(1), F.col("enter"))).alias("v"), "node", "n", score.alias("score"))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, data: the full sets of the wanted classes (node, least), and of other texts that share an id with one of those.

    The class is that of the text itself, as ids may be shared; classes without an id are found by their sets alone.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sets, schema = partial(set_batches, width=width), "node long, data array<long>"
    with_id = texts.join(wanted.where("least is not null").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    without = texts.where("doc_id is null").select("text").mapInArrow(sets, schema)
    without = without.join(wanted.where("least is null").select("node"), "node", "left_semi")
    return with_id.select("text").mapInArrow(sets, schema).unionByName(without)


def near_links(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, percent: int, size: int, certain: bool) -> DataFrame:
    """node, component of all classes that are linked to another."""
    share, margin = (0.0, 1.0) if certain else (SURE, MARGIN)
    lists = materialize(lists_of(classes, percent, size, share), "lists")
    sketches = classes.select("node", F.col("sketch").alias("data"))
    inside = lists.select("node").distinct()
    sets = materialize(full_sets(docs, ids.join(inside, "node", "left_semi"), width), "sets")
    full = sets.dropDuplicates(["node"])

    heads = lists.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("score", "node", "n")).alias("p"))
    heads = materialize(heads.where("members > 1").select("v", "members", F.col("p.node").alias("p"), F.col("p.n").alias("pn")), "heads")
    met = lists.join(heads, "v").where((F.col("node") != F.col("p")) & _fits(F.col("n"), F.col("pn"), percent))
    pairs = materialize(met.select(F.col("p").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    maybe = meet(pairs, sketches, estimate, percent, size, margin, "estimated")
    links = meet(maybe, full, exact, percent, size, margin, "links")
    labels = materialize(components(links), "labels")
    discard(pairs, maybe)

    # lists of three or more that still hold several components, as members of the clusters around their central texts
    named = lists.join(labels, "node", "left").select("v", "node", "n", F.coalesce("component", "node").alias("comp"))
    named = materialize(named, "named-lists")
    open_ = named.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v")
    open_ = heads.where("members > 2").join(open_, "v").select("v", "p")
    members = named.join(open_, "v").select("p", "node", "n", "comp").distinct()
    core = labels.select(F.col("node").alias("p"), F.col("component").alias("core"))
    members = members.join(core, "p", "left").withColumn("outer", F.col("comp") != F.coalesce("core", "p")).drop("core")
    members = materialize(members, "cluster-members")
    found = blockwise(members, full, percent, size, share, margin)
    out = materialize(links.unionByName(found).distinct(), "all-links")
    final = materialize(components(out), "labels")
    discard(lists, sets, heads, links, labels, named, members, found, out)
    return final


def blockwise(members: DataFrame, full: DataFrame, percent: int, size: int, share: float, margin: float) -> DataFrame:
    """Links (a, b) that join components, between the outer members of each cluster and all of its members."""

    def blocks(which: Column) -> Column:
        count, total = F.sum(F.when(which, 1).otherwise(0)), F.sum(F.when(which, F.col("n")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(count / BLOCK_TEXTS), F.ceil(total / BLOCK_SHINGLES)).cast("int")

    sizes = members.groupBy("p").agg(blocks(F.col("outer")).alias("na"), blocks(F.lit(True)).alias("nb"), F.max("outer").alias("some"))
    sizes = materialize(sizes.where("some").drop("some"), "cluster-blocks")
    amount = sizes.agg(F.sum(F.col("na").cast("long") * F.col("nb"))).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), amount // 64)
    dealt = members.join(sizes, "p")

    def part(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = dealt.where("outer").select("p", "node", "comp", F.lit(0).alias("side"), "nb", part("na", 1).alias("i"), others("nb").alias("j"))
    right = dealt.select("p", "node", "comp", F.lit(1).alias("side"), "nb", part("nb", 2).alias("j"), others("na").alias("i"))
    # the pairs of blocks of a cluster go to tasks in turn, from a place of its own
    turn = F.pmod(F.xxhash64("p") % tasks + F.col("i").cast("long") * F.col("nb") + F.col("j"), F.lit(tasks)).cast("int")
    rows = left.unionByName(right).join(full, "node").select("p", "i", "j", "side", "node", "comp", "data", turn.alias("task"))
    rows = rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("p", "i", "j", "side", "node")
    run = partial(block_batches, percent=percent, size=size, share=share, margin=margin)
    out = materialize(rows.mapInArrow(run, "a long, b long"), "block-links")
    discard(sizes)
    return out


def block_batches(batches, **how):
    """Gathers the rows of one pair of blocks at a time."""
    key, held = None, ([], [])
    for batch in batches:
        out, data = [], batch.column(6)
        flat, ends = data.values.to_numpy(), data.offsets.to_numpy()
        for k, (p, i, j, side, node, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
            if (p, i, j) != key:
                out += block_links(*held, **how)
                key, held = (p, i, j), ([], [])
            held[side].append((node, comp, flat[ends[k] : ends[k + 1]].copy()))
        yield _links(out)
    yield _links(block_links(*held, **how))


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def block_links(left: list, right: list, percent: int, size: int, share: float, margin: float) -> list[tuple[int, int]]:
    """Of the similar pairs between two blocks of (node, component, set), those that join components not yet joined here.

    Sets are sorted, so their sketches are their first values. Retained values that both have are counted for a whole block at
    once; the estimate from the sketch of the union filters what is left, and full sets decide.
    """
    if not left or not right:
        return []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def overlaps(own: np.ndarray, starts: np.ndarray, values: np.ndarray, flat: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        seen = np.zeros(len(values), bool)
        seen[at[values[at] == own]] = True
        return np.add.reduceat(seen[flat], starts, dtype=np.int64)

    def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        return (starts, *np.unique(np.concatenate(sets), return_inverse=True))

    nodes, sizes = np.array([x for x, _, _ in right]), np.array([len(s) for _, _, s in right])
    sketches = [s[:size] for _, _, s in right]
    held, index, out = np.minimum(sizes, size), joined(sketches), []
    for node, comp, own in left:
        shared = overlaps(own[:size], *index)
        fits = (nodes != node) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
        small = (sizes < size) & (len(own) < size)
        need = np.where(small, 1, np.floor(share * np.minimum(held, len(own))))
        fits &= np.where(small, 100 * shared >= percent * (len(own) + sizes - shared), shared >= need)
        some = [k for k in np.flatnonzero(fits).tolist() if find(comp) != find(right[k][1])]
        sure = [k for k in some if small[k]]  # whole sets, already compared
        maybe = [k for k in some if not small[k]]
        if maybe:
            passed = estimates(own[:size], [sketches[k] for k in maybe], percent, size, margin)
            maybe = [k for k, ok in zip(maybe, passed.tolist(), strict=True) if ok]
        if maybe:
            both = overlaps(own, *joined([right[k][2] for k in maybe]))
            sure += [k for k, n in zip(maybe, both.tolist(), strict=True) if 100 * n >= percent * (len(own) + sizes[k] - n)]
        for k in sure:
            x, y = find(comp), find(right[k][1])
            if x != y:
                parent[x] = y
                out.append((node, right[k][0]))
    return out


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, size: int = SKETCH, certain: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Texts with 100 * intersection >= percent * union of their shingle sets are linked. A text of fewer words than
    `width` is one shingle; a null text or one without words has none, is linked with nothing and is kept. Rows without an
    id take part as links between others; their component_id is null if no row there has an id, and they are kept only then.
    Rows that repeat an id and text are all kept or none. Other columns are ignored; an empty table gives an empty result.

    Sets beyond a sketch may lose a link with a chance under 1e-6. With `certain`, classes enter all their lists and the estimate
    passes every pair, at the price of more comparisons: only similar texts that share no retained value at all are missed.
    """
    return _verdicts(docs, width, percent, size, certain).select("doc_id", "n_shingles", "component_id", "kept")


def _verdicts(docs: DataFrame, width: int, percent: int, size: int, certain: bool = False) -> DataFrame:
    """As near_dedup(), with the node and the component (of nodes) of each row's text."""
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "doc_id long, n_shingles long, node long, sketch array<long>"
    rows = materialize(texts.mapInArrow(partial(sketch_batches, width=width, size=size), schema), "sketches")
    classes = rows.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
    sizes = ids = materialize(ids, "class-sizes")
    labels = near_links(docs, classes, ids, width, percent, size, certain)
    discard(classes)
    ids = ids.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = materialize(ids, "class-ids")
    named = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    to = materialize(ids.join(named, "component").select("node", "component", "component_id", "members"), "class-components")
    discard(ids, sizes, labels)
    # classes of more than a thousandth of all rows, fewer than a thousand of them, are looked up in a broadcast
    n = rows.count()
    hot = F.broadcast(to.where(F.col("members") * 1000 > F.lit(n)).drop("members"))
    rows = rows.drop("sketch")
    cold = rows.join(hot.select("node"), "node", "left_anti").join(to.drop("members"), "node", "left")
    out = rows.join(hot, "node").unionByName(cold)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "node", "component", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_dedup() keeps, all columns; of rows that share id and component one stays.

    Rows without an id count as sharing theirs if a component holds them; those without a shingle all stay.
    """
    verdict = materialize(_verdicts(docs, width, percent, SKETCH), "near-verdict")
    i, n, of, as_, comp, row, h = (fresh(docs, x) for x in ("id", "node", "of", "as", "component", "row", "hash"))
    unclear = verdict.groupBy(F.col("doc_id").alias(i)).agg(F.count(F.lit(1)).alias(n)).where((F.col(n) > 1) | F.col(i).isNull()).select(i)
    unclear = materialize(unclear, "unclear-ids")
    kept = verdict.where("kept and doc_id is not null").select(F.col("doc_id").alias(i))
    id_ = F.col("doc_id").cast("long")
    if not unclear.limit(1).count():
        return docs.join(kept, id_ == F.col(i), "left_semi")
    shared = unclear.where(F.col(i).isNotNull())
    clear = docs.join(kept.join(shared, i, "left_anti"), id_ == F.col(i), "left_semi")
    # an id that is missing or repeated doesn't tell which text is meant: the text's own class does
    node = F.arrow_udf(lambda texts: pa.array([node_of(shingle_set(t, width)) for t in texts.to_pylist()], pa.int64()), "long")
    own = docs.where("doc_id is null").unionByName(docs.join(shared, id_ == F.col(i), "left_semi"))
    own = own.select(id_.alias(i), node(F.col("text").cast("string")).alias(n), F.struct(*[f"`{c}`" for c in docs.columns]).alias(row), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias(h))
    judged = verdict.where("kept").select(F.col("doc_id").alias(of), F.col("node").alias(as_), F.col("component").alias(comp)).distinct()
    own = own.join(judged, F.col(i).eqNullSafe(F.col(of)) & F.col(n).eqNullSafe(F.col(as_)))
    alone = F.col(i).isNull() & F.col(n).isNull()
    one = own.where(~alone).groupBy(i, comp).agg(F.min_by(row, h).alias(row))
    return clear.unionByName(own.where(alone).select(f"{row}.*")).unionByName(one.select(f"{row}.*"))
