"""Removal of repeated line chunks, in DataFrame operations only.

Lines are hashed, and a rolling hash over two successive line hashes decides where a chunk ends, so that boundaries depend on content and
survive shifts. A line of `long_chars` characters is a chunk by itself (the greatest chunk size). Chunks of several lines, and such long
lines, that occur again anywhere are compared with their first occurrence byte for byte and removed.

Chunk ends are sparse, so a passage shorter than a few chunks can keep most of its lines. Where `passage_words` is given, every run of lines
with more words than that which an earlier place holds is removed as well, whatever chunks it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedra.llm.common import WORD, pick, stage

LONG_CHARS = 200
LEAST_CHARS = 100
#: Of repeated passages, in the query and the pipeline.
PASSAGE_WORDS = 50
#: A rolling hash ends a chunk if its last hexadecimal digit is one of these: every fourth on average.
ENDING = ("0", "4", "8", "c")


def chunked(docs: DataFrame, long_chars: int = LONG_CHARS) -> DataFrame:
    """Adds `_lines` and `_chunks` (start * 2**31 + number of lines, in order) to rows that have `_text`; null for a null text."""
    line = lambda h, long: F.struct(h.alias("h"), long.alias("l"))
    out = docs.withColumn("_lines", F.split("_text", "\n", -1))
    # a column each, so that no line is hashed twice
    out = out.withColumn("_hashed", F.transform("_lines", lambda x: line(F.md5(x.cast("binary")), F.length(x) >= long_chars)))
    before = F.concat(F.array(line(F.lit(""), F.lit(False))), F.slice("_hashed", F.lit(1), F.greatest(F.size("_hashed") - 1, F.lit(0))))
    out = out.withColumn("_rolled", F.zip_with("_hashed", before, lambda x, y: F.struct(x["l"].alias("l"), F.substring(F.md5(F.concat(y["h"], x["h"]).cast("binary")), 32, 1).isin(*ENDING).alias("e"))))
    before = F.concat(F.array(F.struct(F.lit(False).alias("l"), F.lit(True).alias("e"))), F.slice("_rolled", F.lit(1), F.greatest(F.size("_rolled") - 1, F.lit(0))))
    out = out.withColumn("_cut", F.zip_with("_rolled", before, lambda x, y: x["l"] | y["l"] | y["e"]))
    out = out.withColumn("_starts", F.filter(F.transform("_cut", lambda c, i: F.when(c, i)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_lines")))
    return out.withColumn("_chunks", F.zip_with("_starts", ends, lambda a, b: F.shiftleft(a.cast("bigint"), 31) + (b - a))).drop("_hashed", "_rolled", "_cut", "_starts")


def _start(c: Column) -> Column:
    return F.shiftright(c, 31).cast("int")


def _count(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def repeated_chunks(docs: DataFrame, long_chars: int = LONG_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_id, _row and _chunk of every occurrence but the first of a repeated chunk; `docs` has _id, _row and _text."""
    body = lambda c: F.array_join(F.slice("_lines", _start(c) + 1, _count(c)), "\n")
    large = lambda x: (F.length(x["b"]) >= long_chars) | ((F.length(x["b"]) >= least_chars) & (_count(x["c"]) > 1))
    # bodies are cut before the explosion, which would copy all lines to each chunk's row
    bodies = F.filter(F.transform("_chunks", lambda c: F.struct(c.alias("c"), body(c).alias("b"))), large)
    each = chunked(docs, long_chars).select("_id", "_row", F.explode(bodies).alias("_x")).select("_id", "_row", F.col("_x.c").alias("_chunk"), F.col("_x.b").alias("_body"))
    each = each.withColumns({"_h": F.xxhash64("_body"), "_n": F.octet_length("_body")})
    place = F.struct("_id", "_row", "_chunk")
    again = each.groupBy("_h", "_n").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    # only repeated chunks keep their bytes
    found = stage(each.join(stage(again, "repeated"), ["_h", "_n"]), "found")
    first = found.where(place == F.col("_first")).groupBy("_h", "_n").agg(F.min("_body").alias("_bytes"))
    return found.where(place != F.col("_first")).join(first, ["_h", "_n"]).where(F.col("_body") == F.col("_bytes")).select("_id", "_row", "_chunk")


def repeated_passages(docs: DataFrame, words: int) -> DataFrame:
    """_id, _row, and _a and _b (first and last line, from 0) of repeated runs of lines; `docs` has _id, _row and _text.

    At every line that isn't blank begins, and at every one ends, a shortest run of more than `words` words. Those that an earlier place holds
    make up, together, all repeated runs of more than `words` words: a longer one is covered by the runs that begin in it and the last that ends
    in it. Blank lines are passed over. Runs are equal if their lines' SHA-256 digests are. A run that overlaps its first occurrence stays.
    """
    line = lambda x, i: F.struct(i.alias("p"), F.least(F.regexp_count(x, F.lit(WORD)), F.lit(words + 1)).alias("n"), F.unhex(F.sha2(x.cast("binary"), 256)).alias("h"))
    each = docs.select("_id", "_row", F.filter(F.transform(F.split("_text", "\n", -1), line), lambda x: x["n"] > 0).alias("_x"))
    each = each.where(F.aggregate("_x", F.lit(0), lambda a, x: F.least(a + x["n"], F.lit(words + 1))) > words)
    # exactly repeated rows are one document
    each = each.dropDuplicates(["_id", "_row"]).select("_id", "_row", F.inline("_x"))
    own = Window.partitionBy("_id", "_row")
    each = each.withColumn("_to", F.sum("n").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("n"))
    runs = {"_begun": own.orderBy("_from").rangeBetween(0, words), "_ended": own.orderBy("_to").rangeBetween(-words, 0)}
    for name, over in runs.items():
        run = F.struct(F.sha2(F.array_join(F.transform(F.collect_list("h").over(over), F.hex), "").cast("binary"), 256).alias("h"), F.min("p").over(over).alias("a"), F.max("p").over(over).alias("b"))
        each = each.withColumn(name, F.when(F.sum("n").over(over) > words, run))
    found = each.select("_id", "_row", F.explode(F.array_compact(F.array_distinct(F.array(*runs)))).alias("_x")).select("_id", "_row", F.unhex("_x.h").alias("_h"), F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"))
    found = stage(found, "runs")
    again = found.groupBy("_h").agg(F.min(F.struct("_id", "_row", "_a", "_b")).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_row") == F.col("_first._row"))
    return found.join(again, "_h").where(~same | (F.col("_a") > F.col("_first._b"))).select("_id", "_row", "_a", "_b")


def _gone_lines(docs: DataFrame, gone: DataFrame, words: int) -> DataFrame:
    """Adds to the rows of repeated chunks (or null) the lines that go with them and with repeated passages: _lines_gone."""
    passages = repeated_passages(docs, words).groupBy("_id", "_row").agg(F.collect_set(F.struct("_a", "_b")).alias("_runs"))
    passages = passages.select(F.col("_id").alias("_id3"), F.col("_row").alias("_row3"), "_runs")
    both = gone.join(passages, F.col("_id").eqNullSafe(F.col("_id3")) & (F.col("_row") == F.col("_row3")), "full")
    spans = F.concat(
        F.transform(F.coalesce("_gone", F.array().cast("array<bigint>")), lambda c: F.sequence(_start(c), _start(c) + _count(c) - 1)),
        F.transform(F.coalesce("_runs", F.array().cast("array<struct<_a:int,_b:int>>")), lambda x: F.sequence(x["_a"], x["_b"])),
    )
    named = F.col("_row3").isNotNull()
    return both.select(F.when(named, F.col("_id3")).otherwise(F.col("_id")).alias("_id"), F.coalesce("_row", "_row3").alias("_row"), "_gone", F.array_distinct(F.flatten(spans)).alias("_lines_gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS, least_chars: int = LEAST_CHARS, keep: tuple[str, ...] = (), passage_words: int | None = None) -> DataFrame:
    """Texts without repeated chunks: key, text, n_lines, removed_lines, removed_chunks and the columns of `keep`.

    The first occurrence, by key and place, stays. Chunks of one short line never go, nor chunks under `least_chars` characters, unless
    `passage_words` is given and they lie in a repeated run of lines with more words (see `repeated_passages`); removed_lines counts those
    lines too, removed_chunks doesn't. A null text stays null with 0 lines; an empty text is one empty line. Exactly repeated rows are one
    document: they repeat nothing, and get equal results. Null keys come first. An empty table gives an empty result; other columns are ignored.
    Counts are pre-aggregated before the shuffle, and a hot chunk's occurrences meet only its one first occurrence in a join.
    """
    own = pick(docs, _id=key, _text=text, **{f"_keep{i}": c for i, c in enumerate(keep)}).withColumn("_row", F.xxhash64("_text"))
    gone = repeated_chunks(own, long_chars, least_chars).groupBy("_id", "_row").agg(F.collect_set("_chunk").alias("_gone"))
    lines = F.array().cast("array<int>")
    if passage_words is not None:
        gone = _gone_lines(own, gone, passage_words)
        lines = F.col("_lines_gone")
    gone = gone.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "_gone", lines.alias("_lines_gone"))
    both = own.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left")
    kept = F.array_except("_chunks", "_gone")
    body = F.array_join(F.flatten(F.transform(kept, lambda c: F.slice(F.col("_lines"), _start(c) + 1, _count(c)))), "\n")
    less = F.aggregate("_gone", F.lit(0).cast("bigint"), lambda n, c: n + _count(c))
    hit = F.col("_gone").isNotNull()
    if passage_words is not None:
        left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lines_gone")
        body = F.array_join(F.transform(left, lambda i: F.col("_lines")[i]), "\n")
        less, hit = F.size("_lines_gone"), F.col("_lines_gone").isNotNull()
    # a text that loses nothing isn't cut again
    out = chunked(both.withColumnRenamed("_text", "_whole").withColumn("_text", F.when(hit, F.col("_whole"))), long_chars)
    return out.select(
        F.col("_id").alias(key),
        F.when(hit, body).otherwise(F.col("_whole")).alias(text),
        F.when(F.col("_whole").isNull(), 0).otherwise(F.length("_whole") - F.length(F.replace("_whole", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.when(hit, less).otherwise(0).cast("bigint").alias("removed_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("removed_chunks"),
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
    )


_CHUNKS_SQL = f"""
WITH u AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM u),
h AS (SELECT *, md5(line) AS m, length(line) >= {LONG_CHARS} AS long FROM l),
r AS (SELECT *, substr(md5(coalesce(lag(m) OVER w, '') || m), 32, 1) IN {ENDING} AS ending FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
c AS (SELECT *, CASE WHEN pos = 0 OR long OR lag(long) OVER w OR lag(ending) OVER w THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, text ORDER BY pos) AS chunk FROM c),
k AS (SELECT doc_id, text, chunk, min(pos) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM g GROUP BY doc_id, text, chunk),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AND (length(body) >= {LONG_CHARS} OR (n > 1 AND length(body) >= {LEAST_CHARS})) AS gone FROM k),"""
_RESULT_SQL = """SELECT d.doc_id, t.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, coalesce(removed_chunks, 0) AS removed_chunks
FROM documents d LEFT JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.text = t.old
"""
#: DuckDB twin over `documents`, of chunks alone.
SQL = f"""{_CHUNKS_SQL}
t AS (SELECT doc_id, text AS old, coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (NOT gone), '') AS text, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS removed_lines, count(*) FILTER (gone) AS removed_chunks FROM o GROUP BY doc_id, text)
{_RESULT_SQL}"""
#: And with repeated passages.
PASSAGES_SQL = rf"""{_CHUNKS_SQL}
w AS (SELECT doc_id, md5(text) AS doc, pos, md5(line) AS m, least(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), {PASSAGE_WORDS + 1}) AS n FROM l),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, doc ORDER BY pos) AS til FROM w WHERE n > 0),
f AS (SELECT *, til - n AS since FROM e),
begun AS (SELECT doc_id, doc, sum(n) OVER x AS n, list(m) OVER x AS run, min(pos) OVER x AS a, max(pos) OVER x AS b FROM f WINDOW x AS (PARTITION BY doc_id, doc ORDER BY since RANGE BETWEEN CURRENT ROW AND {PASSAGE_WORDS} FOLLOWING)),
ended AS (SELECT doc_id, doc, sum(n) OVER x AS n, list(m) OVER x AS run, min(pos) OVER x AS a, max(pos) OVER x AS b FROM f WINDOW x AS (PARTITION BY doc_id, doc ORDER BY til RANGE BETWEEN {PASSAGE_WORDS} PRECEDING AND CURRENT ROW)),
runs AS (SELECT doc_id, doc, md5(array_to_string(run, '')) AS run, a, b FROM begun WHERE n > {PASSAGE_WORDS} UNION SELECT doc_id, doc, md5(array_to_string(run, '')), a, b FROM ended WHERE n > {PASSAGE_WORDS}),
firsts AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, doc, a) = 1),
passed AS (SELECT DISTINCT r.doc_id, r.doc, unnest(range(r.a, r.b + 1)) AS pos FROM runs r JOIN firsts x USING (run) WHERE r.doc_id IS DISTINCT FROM x.doc_id OR r.doc <> x.doc OR r.a > x.b),
s AS (SELECT g.doc_id, g.text, g.pos, g.line, g.chunk, o.gone, p.pos IS NOT NULL AS again FROM g JOIN o ON g.doc_id IS NOT DISTINCT FROM o.doc_id AND g.text = o.text AND g.chunk = o.chunk LEFT JOIN passed p ON g.doc_id IS NOT DISTINCT FROM p.doc_id AND md5(g.text) = p.doc AND g.pos = p.pos),
t AS (SELECT doc_id, text AS old, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone AND NOT again), '') AS text, count(*) AS n_lines, count(*) FILTER (gone OR again) AS removed_lines, count(DISTINCT chunk) FILTER (gone) AS removed_chunks FROM s GROUP BY doc_id, text)
{_RESULT_SQL}"""
