import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stowage.errors import GraphError
from stowage.plans import graph


def frames(spark, nodes, edges):
    return (
        spark.createDataFrame([(n,) for n in nodes], "key string"),
        spark.createDataFrame(list(edges), "key string, requisite string"),
    )


def waves(spark, nodes, edges):
    return {r.key: r.wave for r in graph.restore_waves(*frames(spark, nodes, edges)).collect()}


def expected_waves(nodes, edges):
    requisites = {n: {r for k, r in edges if k == n and r in nodes} for n in nodes}
    found = {}
    while len(found) < len(nodes):
        ready = [n for n in nodes if n not in found and requisites[n] <= set(found)]
        for n in ready:
            found[n] = 1 + max((found[r] for r in requisites[n]), default=-1)
    return found


def test_chain_diamond_and_external(spark):
    nodes = ["a", "b", "c", "d", "e", "alone"]
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "c"), ("e", "d"), ("a", "outside"), ("stray", "a")]
    assert waves(spark, nodes, edges) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "alone": 0}


def test_no_edges(spark):
    assert waves(spark, ["a", "b"], []) == {"a": 0, "b": 0}


@pytest.mark.parametrize("edges", [[("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]])
def test_cycles_raise(spark, edges):
    with pytest.raises(GraphError, match="cycle, such as a"):
        waves(spark, ["a", "b", "c", "d"], edges)


def test_duplicate_nodes_raise(spark):
    with pytest.raises(GraphError, match="duplicate nodes: a"):
        waves(spark, ["a", "b", "a"], [])


def test_external_and_ready(spark):
    nodes, edges = frames(spark, ["a", "b", "c"], [("b", "a"), ("c", "b"), ("c", "x"), ("a", "y")])
    done = spark.createDataFrame([("a",)], "key string")
    assert {tuple(r) for r in graph.external_requisites(nodes, edges).collect()} == {("c", "x"), ("a", "y")}
    assert {tuple(r) for r in graph.external_requisites(nodes, edges, done).collect()} == {("c", "x"), ("a", "y"), ("b", "a")}
    assert [r.key for r in graph.ready_nodes(nodes, edges, done).collect()] == ["b"]


def test_blocked_by_smallest_failed_ancestor(spark):
    nodes, edges = frames(
        spark, list("abcdefg"), [("c", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "b"), ("g", "x")]
    )
    failed = spark.createDataFrame([("b",), ("a",), ("d",)], "key string")
    found = {r.key: r.failed_requisite for r in graph.blocked_dependents(nodes, edges, failed).collect()}
    assert found == {"c": "a", "e": "a", "f": "b"}


def test_one_requisite_of_everything(spark):
    nodes = ["hub", *(f"n{i}" for i in range(3000))]
    edges = [(n, "hub") for n in nodes[1:]]
    found = waves(spark, nodes, edges)
    assert found["hub"] == 0 and set(found.values()) == {0, 1}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), size=st.integers(1, 40))
def test_random_graphs_match_brute_force(spark, seed, size):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(size)]
    edges = {(nodes[j], nodes[i]) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.1}
    found = waves(spark, nodes, edges)
    assert found == expected_waves(nodes, edges)
    assert all(found[k] > found[r] for k, r in edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 3000, []
    counted = graph._counted
    monkeypatch.setattr(graph, "_counted", lambda df, path, **m: written.append(path) or counted(df, path, **m))
    nodes = spark.range(n).selectExpr("CAST(id AS STRING) AS key")
    edges = spark.range(1, n).selectExpr("CAST(id AS STRING) AS key", "CAST(id - 1 AS STRING) AS requisite")
    assert graph.restore_waves(nodes, edges).where("wave <> CAST(key AS INT)").isEmpty()
    assert len(written) < 20
    written.clear()
    failed = spark.createDataFrame([("100",), ("2000",)], "key string")
    found = {r.key: r.failed_requisite for r in graph.blocked_dependents(nodes, edges, failed).collect()}
    assert found == {str(i): "100" for i in range(101, n) if i != 2000}
    assert len(written) < 20


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32))
def test_contracted_walks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    rng.shuffle(names)
    edges = {(names[i], names[j]) for i in range(40) for j in rng.sample(range(i), min(i, rng.choice((0, 1, 1, 1, 2, 3))))}
    assert waves(spark, names, edges) == expected_waves(names, edges)
    failed = set(rng.sample(names, 5))
    causes = {n: {n} & failed for n in names}
    for _ in names:
        for k, r in edges:
            causes[k] = causes[k] | causes[r]
    expected = {n: min(c) for n, c in causes.items() if c and n not in failed}
    found = graph.blocked_dependents(*frames(spark, names, edges), spark.createDataFrame([(f,) for f in failed], "key string"))
    assert {r.key: r.failed_requisite for r in found.collect()} == expected


def test_blocked_in_and_behind_a_circle(spark):
    nodes, edges = frames(spark, list("abcdefg"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("e", "g"), ("f", "g")])
    found = {r.key: r.failed_requisite for r in graph.blocked_dependents(nodes, edges, spark.createDataFrame([("b",)], "key string")).collect()}
    assert found == {"a": "b", "c": "b", "d": "b", "e": "b"}


def test_nodes_at_their_root_are_not_joined_again(spark, monkeypatch):
    seen, counted = {}, graph._counted

    def noted(df, path, **metrics):
        out, found = counted(df, path, **metrics)
        if "/chains-" in path:
            seen[path.rsplit("-", 1)[1]] = found["open"]
        return out, found

    monkeypatch.setattr(graph, "_counted", noted)
    assert waves(spark, ["hub", "a", "b", "c"], [(n, "hub") for n in "abc"]) == {"hub": 0, "a": 1, "b": 1, "c": 1}
    assert seen == {"0": 0}
    seen.clear()
    nodes = spark.range(64).selectExpr("id AS key")
    edges = spark.range(1, 64).selectExpr("id AS key", "id DIV 2 AS requisite")
    found = {r.key: r.wave for r in graph.restore_waves(nodes, edges).collect()}
    assert found == {n: n.bit_length() for n in range(64)}
    # Of the nodes 1 to 63, those one, two and four steps or more above node 1; before, all 63 were joined at node 0.
    assert seen == {"0": 62, "1": 60, "2": 48, "3": 0}
