import random

import pytest

from stemma.operators import graph, state


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def ids(spark, them):
    return spark.createDataFrame([(x,) for x in them], "id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_levels_and_reduction_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(60)) if a < b}
    up = {x: {a for a, b in edges if b == x} for x in range(25)}

    def above(x):
        seen, queue = {x: 0}, [x]
        for y in queue:
            for z in up[y]:
                if z not in seen:
                    seen[z] = seen[y] + 1
                    queue.append(z)
        return seen

    e, nodes = edge_table(spark, sorted(edges)), ids(spark, range(25))
    got = graph.closure(e, ids(spark, [24, 20]).selectExpr("id as target", "id"), ("target",)).collect()
    assert {(r.target, r.id, r.depth) for r in got} == {(t, x, d) for t in (24, 20) for x, d in above(t).items()}

    def level(x):
        return 1 + max(map(level, up[x])) if up[x] else 0

    done, residue = graph.peel(nodes, e)
    assert {r.id: r.level for r in done.collect()} == {x: level(x) for x in range(25)} and residue.count() == 0
    redundant = {(a, b) for a, b in edges if any(a in above(o) for o in up[b] - {a})}
    assert {tuple(r) for r in graph.redundant_edges(e).collect()} == redundant
    assert {r.id: r["size"] for r in graph.closure_sizes(e, nodes).collect()} == {x: len(above(x)) for x in range(25)}
    assert {r.id for r in graph.roots(nodes, e).collect()} == {x for x in range(25) if not up[x]}


def test_diamond_and_cycle(spark):
    e = edge_table(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert graph.closure(e, ids(spark, [4])).count() == 4
    e = edge_table(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (5, 5)])
    done, residue = graph.peel(ids(spark, [1]), e)
    assert {r.id for r in done.collect()} == {1} and {r.id for r in residue.collect()} == {2, 3, 4, 5}


def test_assembly(spark):
    rows = [("g", 1, 2, 0.9), ("g", 2, 3, 0.8), ("g", 3, 1, 0.7), ("g", 2, 2, 0.6), ("g", 1, 2, 0.1), ("h", 3, 1, 0.5)]
    got = graph.assemble(spark.createDataFrame(rows, "graph string, src long, dst long, score double")).collect()
    assert sorted((r.graph, r.src, r.dst, r.reason) for r in got if not r.accepted) == [("g", 1, 2, "duplicate"), ("g", 2, 2, "self loop"), ("g", 3, 1, "cycle")]


def node_table(spark, rows):
    return spark.createDataFrame(rows, "id long, external string, blocker_ids array<long>, binding string")


def test_query_state_never_promotes(spark):
    nodes = node_table(spark, [(1, "NOT_APPLICABLE", [], "NOT_APPLICABLE"), (2, "SOURCE_FOUND_AND_VERIFIED", [], "EXISTING_PROJECT_DECLARATIONS")])
    target = ids(spark, [2])
    for disposition, want in (("CANDIDATE", "NOT EVALUABLE"), ("ACCEPTED", "TRUE")):
        e = spark.createDataFrame([(1, 2, disposition)], "src long, dst long, disposition string")
        r = state.query_state(target, nodes, e).first()
        assert (r.dag_complete, r.verification_closed, r.closure_nodes, r.closure_edges) == (want, "NOT ESTABLISHED", 2, 1)
    nodes = node_table(spark, [(1, "BLOCKING_UNRESOLVED_CLAIM", [7, 7], None), (2, "NOT_APPLICABLE", [7], None)])
    r = state.query_state(target, nodes, e).first()
    assert (r.dag_complete, r.verification_closed, r.blocker_refs, r.blockers) == ("FALSE", "FALSE", 3, 1)


def test_long_chains_and_reduction_with_cycles(spark):
    n = 260
    e = edge_table(spark, [(k, k + 1) for k in range(n)])
    got = graph.closure(e, ids(spark, [n])).collect()
    assert {(r.id, r.depth) for r in got} == {(k, n - k) for k in range(n + 1)}
    # 1 -> 4 is passed by 1 -> 2 -> 4; in the cycle 5, 6 each edge from outside is passed through the other
    e = edge_table(spark, [(1, 2), (2, 4), (1, 4), (5, 6), (6, 5), (3, 5), (3, 6), (7, 8)])
    assert {tuple(r) for r in graph.redundant_edges(e).collect()} == {(1, 4), (3, 5), (3, 6)}


def test_ranks_without_one_task(spark):
    from stemma.operators.registry import ranked

    rows = spark.createDataFrame([(f"k{x:04}", x) for x in random.Random(2).sample(range(3000), 1000)], "key string, x long")
    got = {r.key: r.rank for r in ranked(rows, "key", "rank").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got), 1)}


def test_many_rows_stay_out_of_the_driver(spark, monkeypatch):
    # half a million sorted ids are a few hundred kB of packed Parquet; the planner must see what they are as rows
    from stemma.session import cut

    rows = spark.range(500_000)
    assert cut(rows, "sized")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__int__() >= 8 * 500_000
    e = edge_table(spark, [(k, 2 * k + i) for k in range(1, 40) for i in (0, 1)])
    want = {(r.id, r.depth) for r in graph.descendants(e, ids(spark, range(1, 30))).collect()}
    monkeypatch.setattr(graph, "FEW", 4)
    hinted = []
    plain = type(e).hint
    monkeypatch.setattr(type(e), "hint", lambda self, *a: hinted.append(a) or plain(self, *a))
    assert {(r.id, r.depth) for r in graph.descendants(e, ids(spark, range(1, 30))).collect()} == want and ("merge",) in hinted


def test_estimates_send_no_table_to_the_driver(spark):
    # here all tables are small and would be broadcast if the planner were left to go by their files, as those of millions of parts were
    from stemma.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    b, planned = t.bundle(), lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for df in (t.edges(), state.step_edges(b.steps), b.basis()):
        assert "BroadcastHashJoin" not in planned(df)


@pytest.mark.parametrize("few", [0, 3, 1 << 17])
def test_reachable_equals_closures(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    # cycles, loops, edges twice, edges without an end, seeds that no edge has or that are missing, a chain
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(1, 1), (2, 3), (2, 3), (4, None), (None, 5)] + [(k, k + 1) for k in range(100, 112)]
    e = edge_table(spark, pairs)
    for seeds in ([], [77], [None, 2, 4, 4, 77], [100, 3], range(0, 40, 3)):
        got = [r.id for r in graph.reachable_blocked(e, ids(spark, seeds)).collect()]
        want = set(seeds)
        while more := {b for a, b in pairs if a is not None and a in want} - want:
            want |= more
        assert sorted(got, key=str) == sorted(want, key=str)


def test_edges_into_what_was_reached_are_dropped(spark, monkeypatch):
    # two nodes of three are blocked; edges into them need not be followed, nor what was found be joined again
    rows = {}
    plain = graph.cut

    def written(df, tag="cut", path=None):
        out = plain(df, tag, path)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", written)
    n = 300
    e = edge_table(spark, [(k // d, k) for k in range(2, n) for d in (2, 3) if 0 < k // d])
    blocked = [k for k in range(1, n) if k % 3]
    got = {r.id for r in graph.reachable_blocked(e, ids(spark, blocked)).collect()}
    assert got == set(range(1, n))
    assert "steps" not in rows and rows["left"][0] <= e.where("dst % 3 = 0").count() < e.count() / 2
    assert rows["left"] == sorted(set(rows["left"]), reverse=True)
