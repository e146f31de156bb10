import collections

import pytest

from hedra.llm import components
from hedra.llm.jaccard_join import similar_documents
from tests.llm.texts import corpus, edges, empty, shingles, vocabulary


def classes(rows):
    sets, parent = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    for k, s in sets.items():
        for j, c in collections.Counter(j for g in s for j in where[g] if j > k).items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


def group(n, seed=3):
    """A large group around the limit: many of its members are linked with some others only."""
    import random

    rng, vocab = random.Random(seed), vocabulary(seed)
    base = [rng.choice(vocab) for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("rows", [corpus(), corpus(2, 60) + group(150)])
def test_brute_force(spark, rows):
    want = classes(rows)
    got = similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_edges(spark):
    got = similar_documents(edges(spark)).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (0, 1, 2, 3, 4, 5)] == [0, 1, 2, 3, 4, 4] and [by[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert similar_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("n", [None, 300])
def test_components(spark, n):
    """A path, a star, a loop and edges of many a graph, dealt out or in one task; a round writes its labels and counts what changes in the same execution."""
    import random

    rng = random.Random(5)
    pairs = [(i + 1, i) for i in range(100, 160)] + [(300, i) for i in range(301, 340)] + [(7, 7)] + [(a := rng.randrange(1000, 1300), a + rng.randrange(1, 9)) for _ in range(200)]
    top = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in top:
        for a, b in pairs:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    store = spark._jsparkSession.sharedState().statusStore()
    df, before = spark.createDataFrame(pairs, "a bigint, b bigint"), store.executionsCount()
    got = components.components(df, n)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before <= 2 + 10
    assert {r["node"]: r["comp"] for r in got.collect()} == top


def test_few_links_are_one_task(spark):
    """Links that one task can hold are solved in one execution, so that the join takes few."""
    store, wait = spark._jsparkSession.sharedState().statusStore(), lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    df, before = spark.createDataFrame([(i + 1, i) for i in range(3000)] + [(5, 5)], "a bigint, b bigint"), store.executionsCount()
    got = components.components(df, 3001)
    wait()
    assert store.executionsCount() - before == 1
    assert {(r["node"], r["comp"]) for r in got.collect()} == {(i, 0) for i in range(3001)}
    assert components.components(df.limit(0), 0).collect() == []
    before = store.executionsCount()
    got = similar_documents(spark.createDataFrame(corpus(2, 60) + group(150), "doc_id bigint, text string"))
    wait()
    ran = range(before, store.executionsCount())
    assert len(ran) <= 16 and len(got.columns) == 3
