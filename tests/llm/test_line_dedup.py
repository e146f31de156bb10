import random

from hedra.llm.line_dedup import PASSAGE_WORDS, PASSAGES_SQL, SQL, dedup_lines
from tests.compare import duck, rows
from tests.llm.texts import edge_rows, edges, empty, frame, sentence, vocabulary


def test_sql_twin(spark):
    rng, vocab = random.Random(8), vocabulary(8)
    pool = [[sentence(rng, vocab, rng.randint(3, 12)) for _ in range(rng.randint(5, 20))] for _ in range(5)]
    docs = []
    for i in range(80):
        lines = [sentence(rng, vocab, rng.randint(2, 60)) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(lines))
        docs.append((i, "\n".join(lines[:at] + (rng.choice(pool) if i % 2 else []) + lines[at:])))
    own = frame(docs)
    got = dedup_lines(spark.createDataFrame(own)).toPandas()
    assert rows(got) == rows(duck(SQL, None, documents=own)) and got.removed_chunks.sum() > 0


def test_sql_twin_with_passages(spark):
    rng, vocab = random.Random(9), vocabulary(9)
    pool = [[sentence(rng, vocab, rng.randint(3, 30)) for _ in range(rng.randint(2, 12))] for _ in range(6)]
    pool.append([sentence(rng, vocab, 26)] * 5)
    docs = []
    for i in range(80):
        lines = [rng.choice(["", " ", sentence(rng, vocab, rng.randint(2, 60))]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(lines))
        docs.append((i, "\n".join(lines[:at] + (rng.choice(pool) if i % 2 else []) + lines[at:])))
    own = frame([*docs, (80, None), (81, "")])
    got = dedup_lines(spark.createDataFrame(own), passage_words=PASSAGE_WORDS).toPandas()
    assert rows(got) == rows(duck(PASSAGES_SQL, None, documents=own))
    assert got.removed_lines.sum() > dedup_lines(spark.createDataFrame(own)).toPandas().removed_lines.sum()


def test_shifted_passages_go(spark):
    rng, vocab = random.Random(1), vocabulary(1)
    passage = "\n".join(sentence(rng, vocab, 8) for _ in range(30))
    docs = [(i, "\n".join([*(sentence(rng, vocab, 7) for _ in range(i)), passage, sentence(rng, vocab, 9)])) for i in range(6)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0]["removed_chunks"] == 0 and got[0]["text"] == docs[0][1]
    assert all(got[i]["removed_lines"] >= 10 for i in range(1, 6)), [got[i]["removed_lines"] for i in range(6)]
    for i in range(1, 6):
        assert docs[i][1].split("\n")[0] in got[i]["text"]  # lines of its own stay


def test_edges(spark):
    got = dedup_lines(edges(spark), keep=("source",)).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["text"] is None and by[0]["n_lines"] == 0 and by[1]["text"] == "" and by[1]["n_lines"] == 1
    assert all(r["removed_chunks"] == 0 for r in got) and by[9]["text"] == edge_rows()[9][1]
    assert dedup_lines(empty(spark)).collect() == []


def brute_lines(docs, words):
    """Lines of every document that lie in a run of more than `words` words which an earlier place holds without overlap."""
    flat = [(k, [(i, x) for i, x in enumerate(t.split("\n")) if x.split()]) for k, t in docs]
    gone = {k: set() for k, _ in docs}
    for k, a in flat:
        for k2, b in flat:
            if k2 > k:
                continue
            for i in range(len(a)):
                for j in range(len(b)):
                    if k2 == k and j >= i:
                        break
                    n = size = 0
                    while i + n < len(a) and j + n < len(b) and (k2 < k or j + n < i) and a[i + n][1] == b[j + n][1]:
                        size += len(a[i + n][1].split())
                        n += 1
                    if size > words:
                        gone[k].update(range(a[i][0], a[i + n - 1][0] + 1))
    return gone


def test_passages_against_brute_force(spark):
    rng, vocab = random.Random(3), vocabulary(3)
    pool = [[sentence(rng, vocab, n) for _ in range(k)] for n, k in ((12, 5), (30, 4), (30, 8), (12, 12), (17, 3), (51, 1), (10, 5), (25, 2))]
    pool.append([sentence(rng, vocab, 26)] * 5)
    docs = []
    for i in range(60):
        lines = [sentence(rng, vocab, rng.randint(1, 20)) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            at, copy = rng.randint(0, len(lines)), list(rng.choice(pool))
            if rng.random() < 0.3:
                copy.insert(rng.randint(0, len(copy)), " ")
            lines[at:at] = copy[rng.randint(0, 1) :]
        docs.append((i, "\n".join(lines)))
    want = brute_lines(docs, 50)
    # chunks never count: no text is that long
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), long_chars=10**9, least_chars=10**9, passage_words=50).collect()}
    assert sum(map(len, want.values())) > 100
    for k, t in docs:
        assert got[k]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k]) and got[k]["removed_lines"] == len(want[k])
    # and with chunks, all of that goes as well
    both = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), passage_words=50).collect()}
    plain = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(both[k]["removed_lines"] >= max(len(want[k]), plain[k]["removed_lines"]) for k, _ in docs)
    assert sum(r["removed_lines"] for r in plain.values()) < sum(map(len, want.values()))


def test_passage_edges(spark):
    got = dedup_lines(edges(spark), keep=("source",), passage_words=50).collect()
    assert len(got) == 13 and all(r["removed_lines"] == 0 for r in got)
    assert dedup_lines(empty(spark), passage_words=50).collect() == []
    page = "\n".join(f"line {i} of a page" for i in range(30))
    two = spark.createDataFrame([(None, page), (None, page), (1, page)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["removed_lines"]) for r in dedup_lines(two, passage_words=50).collect()) == [(0, 0), (0, 0), (1, 30)]
