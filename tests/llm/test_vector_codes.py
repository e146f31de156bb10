import hashlib
import math

import numpy as np

from hedra.llm import vector_codes
from hedra.llm.queries import op12_segment_codes
from tests.compare import duck, rows


def brute(table, parts=8, entries=16, rounds=6):
    """{row number: (code, error)}, and the digest, by plain loops over Python's integers."""
    kept = [(i, v) for i, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    floor = lambda x: int(x) * 4096 if abs(x) > 1e15 else math.floor(x * 4096)
    kept = sorted(((i is None, i or 0, v), n) for n, (i, v) in enumerate(kept))
    ints = [[floor(x) for x in key[2]] for key, _ in kept]
    width = len(ints[0]) // parts
    at = [slice(p * width, (p + 1) * width) for p in range(parts)]
    books = [[list(v[s]) for v in ints[:entries]] for s in at]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for s, book in zip(at, books, strict=True):
            got = [near(v[s], book)[1] for v in ints]
            for j in range(len(book)):
                own = [v[s] for v, g in zip(ints, got, strict=True) if g == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for v in ints:
        found = [near(v[s], b) for s, b in zip(at, books, strict=True)]
        out.append(("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return [(k[1] if not k[0] else None, *o) for (k, _), o in zip(kept, out, strict=True)], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, x string, code int")


def test_query_equals_sql(spark, sf):
    assert rows(op12_segment_codes(spark, sf).toPandas()) == rows(duck(vector_codes.SQL, sf))


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    data = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=16) * 0.1], i % 3 or None, "clash", 1) for i in range(90)]
    data += [data[3], data[3], (None, [0.5] * 16, 1, None, None), (200, None, 1, None, None), (201, [math.nan] + [0.0] * 15, 2, None, None), (202, [None] + [0.0] * 15, 2, None, None), (203, [math.inf] * 16, 2, None, None)]
    got = vector_codes.compress_vectors(frame(spark, data).repartition(5)).collect()
    want, digest = brute([d[:2] for d in data])
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.code, r.error)) for r in got)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums, labels = {}, {d[0]: d[2] for d in data}
    for i, _, e in want:
        sums[labels[i]] = sums.get(labels[i], 0) + e
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got)


def test_nearest_is_exact_and_filters():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 8, 16):
        for size in (3, 2000):
            book, v = rng.integers(-size, size, (16, width)), rng.integers(-size, size, (500, width))
            v[:100] = book[rng.integers(0, 16, 100)]  # ties at distance 0
            book[9] = book[2]
            d = ((v[:, None] - book) ** 2).sum(2)
            entry, least, spent = vector_codes.nearest(v, book)
            assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
            assert spent <= d.size + len(v)
    smooth = np.cumsum(rng.integers(-50, 50, (400, 8)), 1)
    assert vector_codes.nearest(smooth, smooth[:16])[2] < 0.5 * 400 * 16


def test_large_numbers_and_odd_widths(spark):
    data = [(i, [x * 10.0 ** (40 * (i % 4)) for x in (0.1 * i, -2.5, 3.0, 1e-3, 7.0, 0.0, -0.0, i * 1.5)], i % 2, None, None) for i in range(30)]
    want, digest = brute([d[:2] for d in data])
    got = vector_codes.compress_vectors(frame(spark, data)).collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted(map(repr, ((i, c, e if e < 1 << 63 else None) for i, c, e in want))) == sorted(repr((r.vec_id, r.code, r.error)) for r in got)
    mixed = [(1, [1.0] * 10, 1, None, None), (2, [2.0] * 10, 1, None, None), (3, [1.0] * 4, None, None, None), (4, [], None, None, None)]
    got = {r.vec_id: r for r in vector_codes.compress_vectors(frame(spark, mixed)).collect()}
    assert got[1].code == "00" * 8 and got[2].code == "01" * 8 and got[1].error == 0 and got[3].code is None and got[4].error is None and got[4].label_error is None
    assert vector_codes.compress_vectors(frame(spark, [(1, [], 1, None, None)])).first().code == "00" * 8


def test_empty(spark):
    assert vector_codes.compress_vectors(frame(spark, [])).count() == 0
    assert vector_codes.compress_vectors(frame(spark, [(1, None, 1, None, None)])).count() == 0
