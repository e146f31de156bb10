import hashlib
import random
import zlib

from hedra.llm import prefix_trie
from hedra.llm.queries import op13_patricia_prefixes
from tests.compare import duck, rows
from tests.llm.texts import words


def tree(members):
    """Rows of all nodes from {id: [(turn, words)]}, by plain loops."""
    at = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            at.setdefault(tuple(t for t, _ in turns[:d]), []).append(c)
    size = {p: dict(turns)[p[-1]] if p else 0 for c, turns in members.items() for p in [tuple(t for t, _ in turns[:d]) for d in range(len(turns) + 1)]}
    whole = {c: tuple(t for t, _ in turns) for c, turns in members.items()}
    out = []
    for p, own in at.items():
        below = [q for q in at if q[: len(p)] == p]
        children = lambda q: [r for r in at if len(r) == len(q) + 1 and r[: len(q)] == q]
        ends = ",".join(str(c) for c in sorted(c for c in own if whole[c] == p))
        saved = sum((len(at[q]) - 1) * size[q] for q in below)
        out.append((min(own), len(p), min(at[p[:-1]]) if p else None, len(own), len(children(p)), sum(not children(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(data, every=20, heads=4):
    """{id: [((role, text), words)]} of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [((x[2], x[4]), len(words(x[4]))) for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    near = lambda c: c - c % every if c >= 0 else c + -c % every  # noqa: E731 - the remainder has the sign of c, as in SQL
    return {c: own.get(near(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def test_query_equals_sql(spark, sf):
    assert rows(op13_patricia_prefixes(spark, sf).toPandas()) == rows(duck(prefix_trie.SQL, sf))


def test_points_of_any_partitions_make_one_tree():
    rng = random.Random(5)
    for trial in range(60):
        turns = [(bytes([65 + i]) * 16, rng.randint(0, 9)) for i in range(3)]
        members = {c: [rng.choice(turns) for _ in range(rng.choice([0, 1, 2, 5, 9]))] for c in rng.sample(range(500), rng.randint(1, 40))}
        groups = {}
        for c, seq in members.items():
            groups.setdefault(b"".join(t + w.to_bytes(4, "big") for t, w in seq), []).append(c)
        keys = sorted((k, len(v), min(v), hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for k, v in groups.items())
        cuts = sorted(rng.sample(range(1, len(keys)), min(len(keys) - 1, rng.randint(0, 12)))) if trial % 4 else []
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        met = [-1, *(prefix_trie.common_turns(a[-1][0], b[0][0]) for a, b in zip(parts, parts[1:], strict=False)), -1]
        found = [p for part, left, right in zip(parts, met, met[1:], strict=False) for p in prefix_trie.points(part, left, right)]
        across, done = {}, []
        for p in found:
            if p[0] is None:
                done.append(p)
                continue
            s = across.setdefault(p[0], [*p[:2], p[2], 0, 0, 0, 0, 0, prefix_trie.NOTHING, [], None, p[11]])
            s[2] = min(s[2], p[2])
            for i in range(3, 8):
                s[i] += p[i]
            s[8] = p[8] if p[8] != prefix_trie.NOTHING else s[8]
        out = []
        for p in [*done, *across.values()]:
            parent = across[p[11]][2] if p[11] else p[10]
            for up in range(len(p[9]) + 1):
                out.append((p[2], p[1] - up, p[2] if up < len(p[9]) else parent, p[3], 1 if up else p[4], p[5], p[6] - p[7] + ((p[3] - 1) * p[9][up - 1] if up else 0), prefix_trie.NOTHING if up else p[8]))
        assert sorted(out, key=repr) == tree(members)
        # unary nodes are no points
        assert len(cuts) or len(found) <= 2 * len(groups) + 1


def test_brute_force_and_edges(spark):
    rng = random.Random(8)
    texts = [None, "", "a b", "a b ", "Long " * 3000, "ünï 日本 \U0001f600", "x\ty\x1fz"]
    data = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(0, 70), -3, -20, 5_000_000_000] for t in range(rng.choice([1, 1, 2, 4]))]
    data += [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (None, 1, "user", "nobody's")]
    data += [(c, t, "user", f"hot {t}") for c in range(1000, 1400) for t in range(6)]
    data += [(2000, t, "user", str(t % 7)) for t in range(900)]
    df = spark.createDataFrame([(*r, "x", 1, b"k") for r in data], "conv_id bigint, turn bigint, role string, text string, key string, n int, sid binary")
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df.repartition(6)).collect()), key=repr)
    assert got == tree(rebuilt(data))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0
    alone = spark.createDataFrame([(1, 0, "user", "a")], df.schema)
    assert [tuple(r) for r in prefix_trie.prefix_trie(alone).collect()] == tree(rebuilt([(1, 0, "user", "a")]))
