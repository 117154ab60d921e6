import random


from fieldweave.operators.components import components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_random_graphs_and_loops(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500, 500), (7, 7)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    got = components(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()
    assert dict(map(tuple, got)) == union_find(edges) and len(got) == len(union_find(edges))


def test_words_and_no_edges(spark):
    got = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "u string, v string")).collect()
    assert dict(map(tuple, got)) == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z"}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
