"""A corpus pipeline of five operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedra.llm.common import read, stage
from hedra.llm.decontaminate import leaks
from hedra.llm.jaccard_join import similar_documents
from hedra.llm.language_id import identify_languages
from hedra.llm.line_dedup import PASSAGE_WORDS, dedup_lines
from hedra.llm.piece_encoding import encode_pieces
from hedra.llm.queries import piece_model

#: Score from which a predicted language takes the place of a label.
SURE = 0.9


def _plain(docs: DataFrame, *own: str) -> DataFrame:
    """The same columns under names that no operator gives its results: those of `own` as they are, others by place. `toDF(*docs.columns)` brings theirs back."""
    return docs.toDF(*[c if c in own else f"_in{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without a letter, with an empty or a null text go. The predicted language is set where they name none, and
    in place of a label that it contradicts with a score of at least SURE; a less sure contradiction leaves the label. Repeated rows and null ids are
    judged each for itself, an empty table stays empty, and other columns, whatever their names, go through."""
    own = _plain(docs, "doc_id", "text", "lang")
    said = identify_languages(own, keep=tuple(c for c in own.columns if c != "doc_id")).where("lang_pred != 'und'")
    chosen = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return said.withColumn("lang", chosen).select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the line chunks, and the runs of lines of over 50 words, that an earlier document or place holds; a document of which nothing
    but blanks is left goes, one that loses nothing stays as it is, with a null or empty text too. n_chars follows the text. Ties of id (null ones come first) are put in
    order by the text's hash, exactly repeated rows are one document and repeat nothing; an empty table stays empty, and other columns, whatever their names, go through."""
    own = _plain(docs, "doc_id", "text")
    rest = tuple(c for c in own.columns if c not in ("doc_id", "text"))
    done = dedup_lines(own, keep=rest, passage_words=PASSAGE_WORDS).where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        n = own.columns[docs.columns.index("n_chars")]
        done = done.withColumn(n, F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return done.select(*own.columns).toDF(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` but those whose id (null or not) and hash of the text are in `gone` (_id, _row)."""
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_row"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal id and text the one whose other columns have the least hash stays; then the row of least id (and hash of the text; null ids last) of
    each class of near duplicates. Null and blank texts are near nothing; an empty table stays empty, and other columns, whatever their names, go through."""
    own, row = _plain(docs, "doc_id", "text"), F.xxhash64("text")
    rest = [c for c in own.columns if c not in ("doc_id", "text")]
    again = own.groupBy(F.col("doc_id").alias("_id"), row.alias("_row")).count().where("count > 1").drop("count")
    twice = own.join(again, own["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(own["text"]) == again["_row"]), "left_semi")
    first = twice.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_rest")).select("doc_id", "text", "_rest.*") if rest else twice.distinct()
    once = _without(own, again).unionByName(first)
    key = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), row.alias("row"))
    gone = similar_documents(own.select(key.alias("doc_id"), "text")).where("component_id != doc_id")
    gone = stage(gone.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.row").alias("_row")).distinct(), "gone")
    return _without(once, gone).select(*own.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; others of the same id stay, and repeated rows go or stay together. Null and blank texts hold nothing; an empty table stays
    empty, without a benchmark nothing goes, and other columns, whatever their names, go through."""
    own = _plain(docs, "doc_id", "text")
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    found = leaks(own.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(own, found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.row").alias("_row")).distinct()).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids with their byte spans, and the decoded text of every row; a null text is empty. Other columns are left out."""
    return encode_pieces(docs, piece_model())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can express neither the language machines nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
