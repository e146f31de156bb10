"""Queries over the test tables, one or more for each operator, with DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedra.functions import parse, rules, transforms
from hedra.operators import cost, encode, ledger, ordered, policy, profile, records, regress, reproduce, resample, score, search
from hedra.operators.encode import Encoder
from hedra.operators.regress import CONST
from hedra.plans import batch, cache
from hedra.plans.ingest import Ingested, Source, ingest_csv
from hedra.plans.valuation import Request, assess, value
from hedra.sources import tabular
from hedra.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- reading numbers ---------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all lines as spreadsheet texts, in ten forms."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10)).alias("form"))
    en = F.format_number("x", 2)
    pt = F.translate(en, ",.", ".,")
    whole = F.floor("x").cast("string")
    forms = [en, pt, F.concat(F.lit("R$ "), pt), F.concat(F.lit("-"), en), whole, F.concat(whole, F.lit(".123")), F.concat(whole, F.lit(",")), F.lit("n/a"), F.concat(whole, F.lit("m2")), F.concat(whole, F.lit("e2"))]
    text = F.element_at(F.array(*forms), F.col("form").cast("int") + 1)
    return li.withColumn("text", text)


_TEXTS = "WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, (l_orderkey + l_linenumber) % 10 AS form, floor(l_extendedprice) AS w FROM lineitem)"
#: English forms have a dot and maybe commas; Portuguese ones a comma and maybe dots.
_VALUE = "CASE WHEN form IN (0, 1, 2) THEN round(x, 2) WHEN form = 3 THEN -round(x, 2) WHEN form = 4 THEN w WHEN form = 9 THEN w * 100 END"


@query(f"{_TEXTS} SELECT l_orderkey, l_linenumber, CASE form WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'malformed' WHEN 7 THEN 'missing' WHEN 8 THEN 'non_numeric' ELSE 'parsed' END AS status, round({_VALUE}, 2) AS value FROM t")
def parse_numeric_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = parse.parse_number(F.col("text"))
    return _texts(spark, sf_dir).select("l_orderkey", "l_linenumber", said.alias("p")).select("l_orderkey", "l_linenumber", "p.status", r("p.value", 2).alias("value"))


@query(
    f"""{_TEXTS} SELECT l_orderkey, l_linenumber,
    CASE WHEN form IN (1, 2, 4, 9) THEN 'parsed' WHEN form = 7 THEN 'missing' WHEN form = 8 THEN 'non_numeric' WHEN form = 6 THEN 'malformed' WHEN form = 5 THEN 'parsed' WHEN x < 1000 THEN 'parsed' ELSE 'malformed' END AS status,
    CASE WHEN form IN (1, 2) THEN round(x, 2) WHEN form = 4 THEN w WHEN form = 9 THEN w * 100 WHEN form = 5 THEN w * 1000 + 123 WHEN form = 0 AND x < 1000 THEN round(x, 2) WHEN form = 3 AND x < 1000 THEN -round(x, 2) END AS value FROM t"""
)
def parse_numeric_ptbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = parse.parse_number(F.col("text"), "pt-BR")
    return _texts(spark, sf_dir).select("l_orderkey", "l_linenumber", said.alias("p")).select("l_orderkey", "l_linenumber", "p.status", r("p.value", 2).alias("value"))


@query(
    f"""{_TEXTS} SELECT l_orderkey, l_linenumber,
    CASE WHEN form IN (0, 3, 4, 5, 9) THEN 'parsed' WHEN form = 7 THEN 'missing' WHEN form = 8 THEN 'non_numeric' WHEN form = 6 THEN 'malformed' WHEN x < 1000 THEN 'parsed' ELSE 'malformed' END AS status,
    CASE WHEN form = 0 THEN round(x, 2) WHEN form = 3 THEN -round(x, 2) WHEN form = 4 THEN w WHEN form = 9 THEN w * 100 WHEN form = 5 THEN round(w + 0.123, 2) WHEN form IN (1, 2) AND x < 1000 THEN round(x, 2) END AS value FROM t"""
)
def parse_numeric_enus(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = parse.parse_number(F.col("text"), "en-US")
    return _texts(spark, sf_dir).select("l_orderkey", "l_linenumber", said.alias("p")).select("l_orderkey", "l_linenumber", "p.status", r("p.value", 2).alias("value"))


@query("SELECT c_custkey, c_acctbal < 0 AS missing_ingest, c_nationkey % 3 = 0 AS missing_category FROM customer")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    first = F.when(F.col("c_acctbal") < 0, " N/A ").otherwise(F.col("c_name"))
    second = F.when(F.col("c_nationkey") % 3 == 0, F.lit("n.d.")).otherwise(F.lit("sem valor"))
    return c.select("c_custkey", parse.is_missing(first).alias("missing_ingest"), parse.is_missing_category(second).alias("missing_category"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = F.when(F.col("o_orderkey") % 2 == 0, iso).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", iso.alias("iso"), parse.to_timestamp(forms).cast("date").cast("string").alias("day"))


@query("SELECT doc_id, left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13), '＝', '＋', '－', '＠') AS formula, CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13), '＝', '＋', '－', '＠') THEN '''' || text ELSE text END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '=' || text WHEN doc_id % 7 = 1 THEN '@' || text ELSE text END AS text FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, false, '' FROM documents WHERE text IS NULL")
def formula_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 7 == 0, "=").when(F.col("doc_id") % 7 == 1, "@").otherwise("")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(mark, "text").alias("text"))
    return d.select("doc_id", parse.is_formula(F.col("text")).alias("formula"), parse.neutral_cell(F.col("text")).alias("cell"))


@query("SELECT l_orderkey, l_linenumber, 'R$ ' || translate(format('{:,.2f}', round(l_extendedprice, 2)), ',.', '.,') AS shown FROM lineitem")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse.brl(F.col("l_extendedprice")).alias("shown"))


# -- ledger and profiles -----------------------------------------------------------------------------------------------


@query(
    "SELECT d.doc_id, l.quality AS target, CASE WHEN l.quality IS NULL THEN 'pending_target' ELSE 'observed' END AS disposition, (CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END)::INT AS n_missing FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def ledger_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target")), "doc_id", "left")
    return ledger.dispositions(both, "target", ["target"]).select("doc_id", "target", "disposition", F.size("missing_before").alias("n_missing"))


@query("SELECT count(*) AS n_received, count(quality) AS n_observed, count(*) - count(quality) AS n_pending, 0::BIGINT AS n_rejected FROM documents LEFT JOIN labels USING (doc_id)")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ledger.ingest_summary(ledger.dispositions(both, "quality", ["quality"]))


@query("SELECT CAST(o_custkey AS VARCHAR) AS identifier, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_identifiers(read(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT source AS identifier, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dependent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_identifiers(read(spark, sf_dir, "documents"), "source")


@query("SELECT count(*) FILTER (event_type = 'view') AS n_offer, count(*) FILTER (event_type = 'purchase') AS n_transaction, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS n_unknown, count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AS mixed FROM events")
def observation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Oferta ").when(F.col("event_type") == "purchase", "sold").otherwise(F.col("event_type"))
    return profile.observation_kinds(read(spark, sf_dir, "events").select(kind.alias("kind")), "kind")


_PROFILED = ["code", "postcode", "day", "amount"]


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("code"), F.lpad((F.col("o_orderkey") % 90000 + 10000010).cast("string"), 8, "1").alias("postcode"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%.2f", "o_totalprice").alias("amount"))


@query(
    r"""WITH x AS (SELECT 'code' AS "column", lpad(o_custkey::VARCHAR, 9, '0') AS v FROM orders UNION ALL SELECT 'postcode', lpad((o_orderkey % 90000 + 10000010)::VARCHAR, 8, '1') FROM orders
    UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'amount', format('{:.2f}', o_totalprice) FROM orders),
    f AS (SELECT "column", bool_or(regexp_matches(v, '^0[0-9]')) AS leading_zero, bool_and(regexp_matches(v, '^[0-9]{5}-?[0-9]{3}$')) AS postcode, bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) AS date,
    bool_and(regexp_matches(v, '[()\-\s]') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8) AS phone FROM x GROUP BY 1) SELECT *, leading_zero OR postcode OR date OR phone AS non_quantitative FROM f"""
)
def looks_non_quantitative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.looks_non_quantitative(_profiled(spark, sf_dir), _PROFILED)


@query(
    """SELECT 'amount' AS "column", count(*) AS n_present, count(*) AS n_parsed, 'numeric' AS kind FROM orders
    UNION ALL SELECT 'priority', count(*), 0, 'categorical' FROM orders UNION ALL SELECT 'status', count(*), 0, 'categorical' FROM orders"""
)
def infer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.format_string("%.2f", "o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return profile.infer_kinds(o, ["amount", "priority", "status"])


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, max({c}) AS max FROM lineitem" for c in _LINE))
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.market_summary(read(spark, sf_dir, "lineitem"), _LINE)
    return out.select("column", "n", "min", r("mean").alias("mean"), r("median").alias("median"), "max")


@query(" UNION ALL ".join(f"SELECT CASE l_orderkey % 2 WHEN 0 THEN 'train' ELSE 'reserved' END AS side, '{c}' AS \"column\", count({c}) AS n, 0::BIGINT AS n_missing, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(var_pop({c}), 2) AS variance, min({c}) = max({c}) AS constant FROM lineitem GROUP BY 1" for c in _LINE))
def train_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the training side, and of the reserved one beside it."""
    li = read(spark, sf_dir, "lineitem")
    sides = [profile.train_moments(li.where(f"l_orderkey % 2 = {k}"), _LINE).withColumn("side", F.lit(side)) for k, side in enumerate(("train", "reserved"))]
    return sides[0].unionByName(sides[1]).select("side", "column", "n", "n_missing", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r("variance", 2).alias("variance"), "constant")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def category_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.category_support(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    """WITH s AS (SELECT 'o_orderpriority' AS c, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, level) AS k, count(*) OVER (PARTITION BY c) AS n_levels FROM s) SELECT c AS "column", level AS reference, n_levels FROM b WHERE k = 1"""
)
def reference_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = profile.category_support(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return profile.reference_levels(support).select("column", "reference", "n_levels")


@query("SELECT count(*) AS n_rows, count(*) FILTER (abs((c_acctbal - m) / s) <= 1) AS within_1 FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def normal_frequency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s")).first()
    z = (F.col("c_acctbal") - m["m"]) / m["s"]
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(z) <= 1).alias("within_1"))


@query("".join(" UNION ALL " * (i > 0) + f'SELECT {k} AS "limit", round(avg((abs((c_acctbal - m) / s) <= {k})::INT), 9) AS observed, {p} AS normal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)' for i, (k, p) in enumerate(((1.0, 0.6826894921370859), (1.64, 0.8989948330517925), (1.96, 0.9500042097035592)))).replace("SELECT 1.0 AS", "SELECT 1.0::DOUBLE AS").replace("SELECT 1.64 AS", "SELECT 1.64::DOUBLE AS").replace("SELECT 1.96 AS", "SELECT 1.96::DOUBLE AS").replace(" AS normal", "::DOUBLE AS normal"))
def normal_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s")).first()
    return profile.normal_frequencies(c, (F.col("c_acctbal") - m["m"]) / m["s"]).select("limit", r("observed", 9).alias("observed"), "normal")


_HASH = """WITH l AS (SELECT sha256(o_orderkey::VARCHAR) AS h, count(*) AS n FROM orders GROUP BY 1),
    g AS (SELECT substr(h, 1, 3) AS g, sum(('0x' || substr(h, 4, 13))::BIGINT::DECIMAL(38, 0) * n) AS s, sum(n) AS n FROM l GROUP BY 1)
    SELECT sha256('{state}|' || string_agg(g || ':' || s::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY g)) AS sha256{more} FROM g"""


@query(_HASH.format(state="", more=""))
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_hash(read(spark, sf_dir, "orders"), "o_orderkey")


_STATE = '{"encoder": null, "roles": {"o_orderkey": "identifier", "o_totalprice": "target"}, "schema": [["o_orderkey", "bigint"], ["o_totalprice", "double"]]}'


@query(f"SELECT 'plain' AS state, sha256 FROM ({_HASH.format(state='', more='')}) UNION ALL SELECT 'whole', sha256 FROM (" + _HASH.replace("{state}", _STATE).replace("{more}", "") + ")")
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the rows alone, and with schema and roles: two different ones."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    state = profile.canonical_state(o, roles={"o_totalprice": "target", "o_orderkey": "identifier"})
    return profile.dataset_hash(o, "o_orderkey").select(F.lit("plain").alias("state"), "sha256").unionByName(profile.dataset_hash(o, "o_orderkey", state).select(F.lit("whole").alias("state"), "sha256"))


@query()
def sample_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_fingerprint(read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(sum({c}), 2) AS sum, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
        (SELECT string_agg(round(v, 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY k) FROM (SELECT {c} AS v, o_orderkey AS k FROM orders ORDER BY k LIMIT 3)) AS head, (SELECT string_agg(round(v, 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY k) FROM (SELECT {c} AS v, o_orderkey AS k FROM orders ORDER BY k DESC LIMIT 3)) AS tail FROM orders"""
        for c in ("o_totalprice", "o_custkey")
    )
)
def numeric_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.numeric_fingerprint(read(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 3)
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string"))).alias(c)
    return out.select("column", "n", r("sum", 2).alias("sum"), r("mean").alias("mean"), r("sd").alias("sd"), shown("head"), shown("tail"))


@query("SELECT 'o_orderpriority' AS \"column\", list(DISTINCT o_orderpriority ORDER BY o_orderpriority)::VARCHAR AS levels, count(DISTINCT o_orderpriority) AS n_levels FROM orders")
def preview_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.preview(read(spark, sf_dir, "orders"), ["o_orderpriority"])
    return out.select("column", F.concat(F.lit("["), F.array_join("levels", ", "), F.lit("]")).alias("levels"), "n_levels")


# -- sample selection --------------------------------------------------------------------------------------------------


@query(
    """SELECT count(*) AS n_received, count(*) FILTER (t AND quality IS NOT NULL AND known) AS n_used, count(*) FILTER (NOT (t AND quality IS NOT NULL AND known)) AS n_excluded,
    count(*) FILTER (NOT t) AS n_not_in_train, count(*) FILTER (quality IS NULL) AS n_target_missing, count(*) FILTER (t AND quality IS NOT NULL AND NOT known) AS n_predictor_missing
    FROM (SELECT d.doc_id % 2 = 0 AS t, quality, coalesce(lang <> 'de', false) AS known FROM documents d LEFT JOIN labels USING (doc_id))"""
)
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"))
    both = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return ledger.sample_counts(ledger.training_rows(both, F.col("doc_id") % 2 == 0, "quality", ["lang"]))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def train_ids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ledger.only(read(spark, sf_dir, "customer"), ids, "c_custkey").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.s_suppkey, x.s_suppkey IS NOT NULL AS excluded FROM supplier s LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) x USING (s_suppkey) WHERE x.s_suppkey IS NULL")
def reviewed_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    listed = s.where("s_acctbal < 0").select("s_suppkey", F.lit("expert_review").alias("origin"), F.lit("someone").alias("author"))
    kept, _ = ledger.reviewed_exclusions(s, listed, "s_suppkey", "reviewed_exclusions")
    return kept.select("s_suppkey", F.lit(False).alias("excluded"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_nationkey < 5 THEN 'debt | region' WHEN c_acctbal < 0 THEN 'debt' WHEN c_nationkey < 5 THEN 'region' ELSE '' END AS reason FROM customer")
def excluded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    why = c.where("c_acctbal < 0").select("c_custkey", F.lit("debt").alias("reason")).unionByName(c.where("c_nationkey < 5").select("c_custkey", F.lit("region").alias("reason")))
    return ledger.attach_reasons(c.select("c_custkey"), why, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS segment FROM customer")
def evidence_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.create_map(F.lit("name"), "c_name").alias("evidence"))
    blank = c.where("c_acctbal < 0").select("c_custkey", F.create_map(F.lit("name"), F.lit(None).cast("string")).alias("evidence"))
    out = ledger.overlay(old, blank, "c_custkey")
    more = c.where("c_nationkey < 12").select("c_custkey", F.create_map(F.lit("segment"), "c_mktsegment").alias("evidence"))
    return ledger.overlay(out, more, "c_custkey").select("c_custkey", F.col("evidence")["name"].alias("name"), F.col("evidence")["segment"].alias("segment"))


@query("SELECT 'row' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 10 = 0")
def leak_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return ledger.leaks(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 0"), "o_orderkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT count(*) AS n_overlap FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1)")
def partition_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return ledger.overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderkey").agg(F.count(F.lit(1)).alias("n_overlap"))


@query("SELECT 'events' AS origin, event_type AS code, 'value ' || CASE WHEN value < 5 THEN 'low' ELSE 'high' END AS message, count(DISTINCT user_id) AS n_ids, count(*) AS n FROM events GROUP BY ALL")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    issues = e.select(F.lit("events").alias("origin"), F.col("event_type").alias("code"), F.concat(F.lit("value "), F.when(F.col("value") < 5, "low").otherwise("high")).alias("message"), F.col("user_id").alias("affected_id"))
    return ledger.group_issues(issues)


# -- encoding and transforms -------------------------------------------------------------------------------------------


def _priority(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Encoder]:
    """Learned from even keys; an odd key of the least common kind has an unseen level."""
    o = read(spark, sf_dir, "orders").withColumn("level", F.when((F.col("o_orderkey") % 2 == 1) & (F.col("o_orderkey") % 7 == 0), "unseen").otherwise(F.col("o_orderpriority")))
    return o, encode.fit_encoder(o.where("o_orderkey % 2 = 0"), ["o_totalprice"], ["level"], "mean")


_REFERENCE = "(SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_UNSEEN = "(o_orderkey % 2 = 1 AND o_orderkey % 7 = 0)"


@query(f"SELECT o_orderkey, {_UNSEEN} AS unsupported, CASE WHEN {_UNSEEN} THEN NULL WHEN o_orderpriority = {_REFERENCE} THEN 0.0 ELSE 1.0 END::DOUBLE AS indicator_sum FROM orders")
def encode_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, state = _priority(spark, sf_dir)
    total = sum((F.col(c) for c in state.indicators("level").values()), F.lit(0.0))
    return encode.apply_encoder(o, state).select("o_orderkey", F.array_contains("unsupported", "level").alias("unsupported"), total.alias("indicator_sum"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 4 = 0 THEN (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 4 <> 0) ELSE o_totalprice END, 4) AS price FROM orders")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")))
    state = encode.fit_encoder(o.where("o_orderkey % 2 = 0"), ["price"], [], "mean")
    return encode.apply_encoder(o, state).select("o_orderkey", r("price", 4).alias("price"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 4 = 0 THEN (SELECT median(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 4 <> 0) ELSE o_totalprice END, 4) AS price FROM orders")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")))
    state = encode.fit_encoder(o.where("o_orderkey % 2 = 0"), ["price"], [], "median")
    return encode.apply_encoder(o, state).select("o_orderkey", r("price", 4).alias("price"))


@query(
    """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9) AS ln, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 9) AS sqrt, round(CASE WHEN c_acctbal <> 0 THEN 1 / c_acctbal END, 12) AS inverse,
    CASE WHEN c_acctbal < 0 THEN 'domain_negative' WHEN c_acctbal = 0 THEN 'domain_zero' END AS ln_failure FROM customer"""
)
def x_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", r(transforms.transform("ln", x), 9).alias("ln"), r(transforms.transform("sqrt", x), 9).alias("sqrt"), r(transforms.transform("inverse", x), 12).alias("inverse"), transforms.domain_failure("ln", x).alias("ln_failure"))


@query(
    """SELECT 'c_acctbal' AS "column", (CASE WHEN min(c_acctbal) > 0 THEN 7 WHEN bool_or(c_acctbal = 0) THEN 2 ELSE 4 END)::INT AS n_options FROM customer
    UNION ALL SELECT 'c_custkey', (CASE WHEN min(c_custkey) > 0 THEN 7 ELSE 3 END)::INT FROM customer"""
)
def transform_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.domains(read(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"])
    return spark.createDataFrame([(c, len(t)) for c, t in found.items()], "column string, n_options int")


@query("SELECT round(min(l_extendedprice), 2) AS least, round(max(l_extendedprice), 2) AS greatest, round(avg(ln(l_extendedprice)), 6) AS log_mean, round(var_pop(ln(l_extendedprice)), 6) AS log_variance FROM lineitem")
def target_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transforms.fit_target(read(spark, sf_dir, "lineitem"), "l_extendedprice", "log")
    return spark.range(1).select(r(F.lit(s.least), 2).alias("least"), r(F.lit(s.greatest), 2).alias("greatest"), r(F.lit(s.log_mean)).alias("log_mean"), r(F.lit(s.log_variance)).alias("log_variance"))


@query("WITH m AS (SELECT avg(ln(l_extendedprice)) AS mu, var_pop(ln(l_extendedprice)) AS v FROM lineitem) SELECT round(exp(mu), 3) AS median_value, round(exp(mu + v / 2), 3) AS lognormal_mean, round(exp(mu) * (SELECT avg(exp(ln(l_extendedprice) - mu)) FROM lineitem), 3) AS smeared_mean FROM m")
def inverse_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    s = transforms.fit_target(li, "l_extendedprice", "log")
    smear = transforms.smearing_factor(li, F.log("l_extendedprice") - s.log_mean)
    mu = F.lit(s.log_mean)
    return spark.range(1).select(r(transforms.inverse_target(mu), 3).alias("median_value"), r(transforms.inverse_target(mu, "lognormal_mean", s.log_variance), 3).alias("lognormal_mean"), r(transforms.inverse_target(mu, "smearing", smearing=smear), 3).alias("smeared_mean"))


# -- regression --------------------------------------------------------------------------------------------------------


def _simple(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, regress.Fit]:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return p, regress.fit_ols(p, "y", ["x"])


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regress.fit_ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(f.beta[0]), 4), round(float(f.beta[1]), 6), f.n)], "intercept double, slope double, n bigint")


_TWO = """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS s1y, covar_pop(l_extendedprice, l_discount) AS s2y, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem), b AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM m)"""


@query(f"{_TWO} SELECT round(my - b1 * m1 - b2 * m2, 2) AS intercept, round(b1, 4) AS b_quantity, round(b2, 2) AS b_discount FROM b")
def ols_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regress.fit_ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(float(f.beta[0]), 2), round(float(f.beta[1]), 4), round(float(f.beta[2]), 2))], "intercept double, b_quantity double, b_discount double")


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 6) AS slope FROM lineitem")
def ols_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regress.fit_ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], intercept=False)
    return spark.createDataFrame([(round(float(f.beta[0]), 6),)], "slope double")


@query(
    """WITH s AS (SELECT regr_count(l_extendedprice, l_quantity)::DOUBLE AS n, regr_r2(l_extendedprice, l_quantity) AS r2, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem), e AS (SELECT *, syy * (1 - r2) AS sse FROM s)
    SELECT n::BIGINT AS n, round(r2, 6) AS r2, round(1 - (n - 1) / (n - 2) * (1 - r2), 6) AS adj_r2, round(sqrt(sse / (n - 2)), 3) AS sigma, round((syy - sse) / (sse / (n - 2)) / 1000, 3) AS f_thousands,
    round(n * (ln(2 * pi()) + ln(sse / n) + 1) + 4, 2) AS aic, round(n * (ln(2 * pi()) + ln(sse / n) + 1) + 2 * ln(n), 2) AS bic FROM e"""
)
def ols_fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regress.fit_ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    s = f.statistics()
    row = (f.n, round(s["r2"], 6), round(s["adj_r2"], 6), round(s["sigma"], 3), round(s["f"] / 1000, 3), round(s["aic"], 2), round(s["bic"], 2))
    return spark.createDataFrame([row], "n bigint, r2 double, adj_r2 double, sigma double, f_thousands double, aic double, bic double")


@query(
    """WITH s AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x) AS sse, regr_sxx(y, x) AS sxx, count(*) AS n FROM (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part))
    SELECT 'const' AS term, round(a, 3) AS value, round(sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS std_error FROM s, (SELECT avg(p_size) AS mx FROM part) UNION ALL SELECT 'x', round(b, 3), round(sqrt(sse / (n - 2) / sxx), 4) FROM s"""
)
def coefficient_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _simple(spark, sf_dir)
    return regress.coefficients(spark, f).select("term", r("value", 3).alias("value"), r("std_error", 4).alias("std_error"))


_INFLUENCE = """WITH p AS (SELECT p_partkey, p_retailprice AS y, p_size::DOUBLE AS x FROM part), s AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, avg(x) AS mx, count(*)::DOUBLE AS n FROM p),
e AS (SELECT p_partkey, a + b * x AS fitted, y - a - b * x AS residual, 1 / n + (x - mx) * (x - mx) / sxx AS h, n FROM p, s), q AS (SELECT sqrt(sum(residual * residual) / (count(*) - 2)) AS sg FROM e),
i AS (SELECT *, residual / (sg * sqrt(1 - h)) AS stud, residual * residual * h / (2 * sg * sg * (1 - h) * (1 - h)) AS cook FROM e, q)"""


@query(f"{_INFLUENCE} SELECT p_partkey, round(fitted, 4) AS fitted, round(residual, 4) AS residual, round(h, 9) AS leverage, round(stud, 6) AS studentized, round(cook, 9) AS cook FROM i")
def influence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return regress.influence(p, f, "y").select("p_partkey", r("fitted", 4).alias("fitted"), r("residual", 4).alias("residual"), r("leverage", 9).alias("leverage"), r("studentized").alias("studentized"), r("cook", 9).alias("cook"))


@query(f"{_INFLUENCE} SELECT count(*) FILTER (cook > 4 / n OR cook > 1) AS n_cook, count(*) FILTER (abs(stud) > 2.5) AS n_residual, count(*) FILTER (h > 4 / n) AS n_leverage FROM i")
def influence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return regress.influence(p, f, "y").agg(F.count_if("high_cook").alias("n_cook"), F.count_if("high_residual").alias("n_residual"), F.count_if("high_leverage").alias("n_leverage"))


@query(f"{_INFLUENCE} SELECT p_partkey, round(residual / sg, 6) AS standardized FROM i")
def standardized_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return regress.influence(p, f, "y").select("p_partkey", r("standardized").alias("standardized"))


@query(
    """WITH c AS (SELECT *, avg(value) OVER () AS m FROM events), e AS (SELECT value - m AS e, lag(value - m) OVER (ORDER BY ts, event_id) AS b FROM c) SELECT round(sum((e - b) * (e - b)) / sum(e * e), 6) AS durbin_watson FROM e"""
)
def durbin_watson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    mean = e.agg(F.avg("value").alias("m")).first()["m"]
    return ordered.durbin_watson(e, F.col("value") - mean, "ts", "event_id").select(r("durbin_watson").alias("durbin_watson"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _LINE for b in _LINE))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.correlations(read(spark, sf_dir, "lineitem"), _LINE).select("a", "b", r("r").alias("r"))


@query(
    """WITH p AS (SELECT 'l_quantity' AS a, 'twice' AS b, corr(l_quantity, 2 * l_quantity) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_quantity', corr(l_discount, l_quantity) FROM lineitem
    UNION ALL SELECT 'l_discount', 'twice', corr(l_discount, 2 * l_quantity) FROM lineitem) SELECT a, b FROM p WHERE abs(r) >= 1 - 1e-10"""
)
def collinear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("twice", 2 * F.col("l_quantity"))
    return regress.collinear_pairs(li, ["l_quantity", "twice", "l_discount"]).select("a", "b")


@query("SELECT term, round(1 / (1 - c * c), 6) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice')) t(term)")
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regress.fit_ols(read(spark, sf_dir, "lineitem"), "l_tax", ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in f.vif().items() if c != CONST], "term string, vif double")


@query(
    """WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part), s AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p), e AS (SELECT x, (y - a - b * x) * (y - a - b * x) AS e2 FROM p, s) SELECT round(count(*) * regr_r2(e2, x), 6) AS statistic FROM e"""
)
def breusch_pagan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return spark.createDataFrame([(round(regress.breusch_pagan(p, f, "y")[0], 6),)], "statistic double")


# t by its expansion around the normal quantile
@query(
    f"""{_INFLUENCE}, d AS (SELECT *, n - 2 AS df, 1.2815515655446004 AS q FROM i),
    w AS (SELECT *, sg * (q + (q ** 3 + q) / (4 * df) + (5 * q ** 5 + 16 * q ** 3 + 3 * q) / (96 * df ** 2) + (3 * q ** 7 + 19 * q ** 5 + 17 * q ** 3 - 15 * q) / (384 * df ** 3)) AS ts FROM d)
    SELECT p_partkey, round(fitted, 4) AS point, round(fitted - ts * sqrt(h), 4) AS mean_low, round(fitted + ts * sqrt(h), 4) AS mean_high, round(fitted - ts * sqrt(1 + h), 4) AS pred_low, round(fitted + ts * sqrt(1 + h), 4) AS pred_high FROM w"""
)
def mean_and_prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    p = p.withColumns(regress.intervals(f))
    return p.select("p_partkey", *[r(c, 4).alias(c) for c in ("point", "mean_low", "mean_high", "pred_low", "pred_high")])


@query(f"{_INFLUENCE} SELECT p_partkey, round(sg * sqrt(h), 6) AS se_mean, round(sg * sqrt(1 + h), 6) AS se_prediction FROM i")
def interval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    t = f.t_critical()
    p = p.withColumns(regress.intervals(f))
    return p.select("p_partkey", r((F.col("mean_high") - F.col("point")) / t).alias("se_mean"), r((F.col("pred_high") - F.col("point")) / t).alias("se_prediction"))


# -- search ------------------------------------------------------------------------------------------------------------


def _search(spark: SparkSession, sf_dir: str) -> search.Search:
    p = read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return search.search_models(p, "p_retailprice", search.units_of(p, ["size"]))


_OPTION = {"linear": "x", "inverse": "1 / x", "ln": "ln(x)", "sqr": "x * x", "sqrt": "sqrt(x)", "inv_sqr": "1 / (x * x)", "inv_sqrt": "1 / sqrt(x)"}


_EXACT = "WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS (" + " UNION ALL ".join(f"SELECT 'size:{o}|y:identity|int:1' AS candidate_id, sqrt(regr_syy(y, {e}) * (1 - regr_r2(y, {e})) / count(*)) AS rmse FROM p" for o, e in _OPTION.items()) + ") SELECT candidate_id, round(rmse, 6) AS rmse, row_number() OVER (ORDER BY rmse, candidate_id)::INT AS rank FROM c"


@query(_EXACT)
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).records.select("candidate_id", r("rmse").alias("rmse"), "rank")


@query("SELECT 'exact' AS mode, n AS possible, n AS evaluated, true AS exact_optimum_guaranteed FROM (SELECT (CASE WHEN min(p_size) > 0 THEN 7 WHEN bool_or(p_size = 0) THEN 2 ELSE 4 END)::BIGINT AS n FROM part)")
def search_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _search(spark, sf_dir).audit
    return spark.createDataFrame([(a["mode"], a["possible"], a["evaluated"], a["exact_optimum_guaranteed"])], "mode string, possible bigint, evaluated bigint, exact_optimum_guaranteed boolean")


@query(
    """WITH n AS (SELECT (CASE WHEN min(l_quantity) > 0 THEN 7 WHEN min(l_quantity) = 0 THEN 3 WHEN bool_or(l_quantity = 0) THEN 2 ELSE 4 END)::BIGINT AS a, (CASE WHEN min(l_discount) > 0 THEN 7 WHEN min(l_discount) = 0 THEN 3 WHEN bool_or(l_discount = 0) THEN 2 ELSE 4 END)::BIGINT AS b, (CASE WHEN min(l_extendedprice) > 0 THEN 7 WHEN min(l_extendedprice) = 0 THEN 3 WHEN bool_or(l_extendedprice = 0) THEN 2 ELSE 4 END)::BIGINT AS c FROM lineitem)
    SELECT variables::INT AS variables, CASE variables WHEN 1 THEN a + b + c WHEN 2 THEN a + b + c + a * b + a * c + b * c ELSE (1 + a) * (1 + b) * (1 + c) - 1 END AS candidates FROM n, range(1, 4) t(variables)"""
)
def search_space_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one to three variables of the lines, by the transforms that their values allow."""
    found = transforms.domains(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    counts = [len(o) for o in found.values()]
    return spark.createDataFrame([(search.count_candidates(counts, most), most) for most in (1, 2, 3)], "candidates bigint, variables int")


@query()
def search_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    found = search.search_models(li, "l_extendedprice", search.units_of(li, ["l_quantity", "l_discount", "l_tax", "l_suppkey"]), budget=512, mode="approximate")
    return search.admissible(found.records).select("candidate_id", "status", r("rmse", 4).alias("rmse"), "rank", "admissible")


# -- folds -------------------------------------------------------------------------------------------------------------


def _kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))


@query(
    """WITH f AS (SELECT l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT k AS fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, avg(y) AS mean, count(*) AS n_train FROM f, range(5) t(k) WHERE fold <> k GROUP BY k)
    SELECT f.fold::INT AS fold, count(*) AS n, round(avg(abs(a + b * x - y)), 4) AS mae, round(sqrt(avg((a + b * x - y) * (a + b * x - y))), 4) AS rmse, round(avg(abs(mean - y)), 4) AS mean_mae, any_value(n_train) AS n_train FROM f JOIN m USING (fold) GROUP BY f.fold"""
)
def kfold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.evaluate_procedure(_kfold(spark, sf_dir), "fold", "l_extendedprice", ["l_quantity"])
    return out.select("fold", "n", r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"), r("mean_mae", 4).alias("mean_mae"), "n_train")


@query(
    """WITH f AS (SELECT l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT k AS fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM f, range(5) t(k) WHERE fold <> k GROUP BY k),
    e AS (SELECT fold, avg(abs(a + b * x - y)) AS mae FROM f JOIN m USING (fold) GROUP BY fold) SELECT round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd, round(min(mae), 4) AS min, round(max(mae), 4) AS max, count(*) AS n_folds FROM e"""
)
def fold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.evaluate_procedure(_kfold(spark, sf_dir), "fold", "l_extendedprice", ["l_quantity"])
    return profile.fold_statistics(out, "mae").select(*[r(c, 4).alias(c) for c in ("mean", "sd", "min", "max")], "n_folds")


@query("SELECT (doc_id % 4)::INT AS fold, count(quality) AS n_reserved, count(quality) FILTER (doc_id % 3 > 0) AS n_scored, round(count(quality) FILTER (doc_id % 3 > 0) / count(quality), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    scored = both.select((F.col("doc_id") % 4).cast("int").alias("fold"), "quality", F.when(F.col("doc_id") % 3 > 0, "ok").otherwise("failed").alias("status"))
    return resample.coverage(scored, "quality").select("fold", "n_reserved", "n_scored", r("coverage").alias("coverage"))


@query()
def random_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.k_folds(read(spark, sf_dir, "orders"), "o_orderkey", 5, 17).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n_groups, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_group_folds, true AS folds_in_range FROM orders")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pairs of group and fold as groups: no group is split."""
    o = resample.group_folds(read(spark, sf_dir, "orders"), "o_custkey", 5, 17)
    pairs = o.groupBy("o_custkey", "fold").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.count_distinct("o_custkey").alias("n_groups"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_group_folds"), F.bool_and(F.col("fold").between(0, 4)).alias("folds_in_range"))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events), c AS (SELECT day, count(*) AS n FROM d GROUP BY day), e AS (SELECT day, sum(n) OVER (ORDER BY day DESC) AS to_end FROM c),
    k AS (SELECT max(day) AS cut FROM e WHERE to_end >= (SELECT round_even(count(*) * 0.2, 0) FROM d)) SELECT CASE WHEN day >= cut THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM d, k GROUP BY 1"""
)
def temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ordered.temporal_holdout(e, "day", 0.2).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events), u AS (SELECT day, ntile(5) OVER (ORDER BY day) - 1 AS chunk FROM (SELECT DISTINCT day FROM d))
    SELECT k::INT AS fold, CASE WHEN chunk = k THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM d JOIN u USING (day), range(1, 5) t(k) WHERE chunk <= k GROUP BY 1, 2"""
)
def temporal_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ordered.temporal_folds(e, "day", 4).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS pos, (ntile(7) OVER (ORDER BY ts, event_id) - 1)::INT AS chunk FROM events")
def row_numbers_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ordered.number_rows(read(spark, sf_dir, "events"), "ts", "event_id")
    return ordered.even_chunks(numbered, "pos", 7).select("event_id", "pos", "chunk")


@query("SELECT event_id, 'R' || lpad(CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS VARCHAR), 6, '0') AS row_id FROM events")
def row_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits whatever the rows, since the twin's lpad cuts longer numbers; the operator alone gives as many as the greatest number needs."""
    return ordered.row_ids(ordered.number_rows(read(spark, sf_dir, "events"), "ts", "event_id"), digits=6).select("event_id", "row_id")


@query(
    """WITH a AS (SELECT event_id AS pos, value AS x FROM events), b AS (SELECT event_id + 1 AS pos, value AS y FROM events)
    SELECT (SELECT bool_and(x IS NOT DISTINCT FROM y) FROM a FULL JOIN b USING (pos)) AS equal, (SELECT bool_and(x IS NOT DISTINCT FROM y) FROM a JOIN b ON a.pos + 1 = b.pos) AS forward, (SELECT bool_and(x IS NOT DISTINCT FROM y) FROM a JOIN b ON a.pos - 1 = b.pos) AS back"""
)
def shifted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")
    return ordered.shifted_by_one(e, e.withColumn("pos", F.col("pos") + 1), "pos", "value")


@query()
def bootstrap_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _simple(spark, sf_dir)
    models = resample.bootstrap(p, "p_partkey", "y", ["x"], 8, 17)
    return resample.bootstrap_dispersion(p, "p_partkey", models)


@query()
def perturbation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return resample.perturbation(p, "p_partkey", ["x"], f, 5, 17)


@query("SELECT event_type AS variable, count(DISTINCT user_id) AS n, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM events GROUP BY 1")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    chosen = e.groupBy(F.col("user_id").alias("replicate")).agg(F.collect_set("event_type").alias("variables"))
    return resample.selection_frequency(chosen, chosen.count()).select("variable", "n", r("share").alias("share"))


@query(
    """WITH p AS (SELECT p_partkey, p_retailprice AS y, p_size::DOUBLE AS x FROM part), a AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p), c AS (SELECT regr_intercept(y, x) AS c, regr_slope(y, x) AS d FROM p WHERE p_partkey % 10 > 0)
    SELECT round(avg(abs(a + b * x - c - d * x)), 4) AS mean_change, round(max(abs(a + b * x - c - d * x)), 4) AS max_change FROM p, a, c"""
)
def revision_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    out = resample.revision(p, p.where("p_partkey % 10 = 0"), "p_partkey", "y", ["x"], f)
    return out.select(r("mean_change", 4).alias("mean_change"), r("max_change", 4).alias("max_change"))


# -- rules -------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size AS k, (p_partkey % 200)::BIGINT AS n, CASE WHEN p_partkey % 200 >= 6 * (p_size + 1) THEN 3 WHEN p_partkey % 200 >= 4 * (p_size + 1) THEN 2 WHEN p_partkey % 200 >= 3 * (p_size + 1) THEN 1 ELSE 0 END AS grade FROM part")
def item2_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = (F.col("p_partkey") % 200).cast("bigint"), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", k.alias("k"), n.alias("n"), rules.item_2(n, k).alias("grade"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 'in_sample' WHEN l_quantity BETWEEN 5 AND 40 THEN 'extended' ELSE 'outside' END AS position FROM lineitem")
def item4_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.measure_position(F.col("l_quantity"), F.lit(10.0), F.lit(20.0)).alias("position"))


_CLAMP = "least(greatest(l_quantity, 10), 20)"


@query(
    f"""WITH t AS (SELECT *, 1000 + 50 * l_quantity AS p, 1000 + 50 * {_CLAMP} AS q FROM lineitem) SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity NOT BETWEEN 5 AND 40 THEN 0 WHEN l_quantity BETWEEN 10 AND 20 THEN 3 WHEN abs(p - q) / q * 100 <= 15 THEN 2 WHEN abs(p - q) / q * 100 <= 20 THEN 1 ELSE 0 END AS grade FROM t"""
)
def item4_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, a, b = F.col("l_quantity"), F.lit(10.0), F.lit(20.0)
    point, at = 1000 + 50 * x, 1000 + 50 * transforms.clamp(x, a, b)
    position = rules.measure_position(x, a, b)
    delta = F.abs(point - at) / at * 100
    grade = rules.item_4(F.array(position), F.array(F.when(position == "extended", delta)), delta)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", grade.alias("grade"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount, l_tax) <= .1 THEN 3 WHEN greatest(l_discount, l_tax) <= .2 THEN 2 WHEN greatest(l_discount, l_tax) <= .3 THEN 1 ELSE 0 END AS item_5,
    CASE WHEN l_tax <= .01 THEN 3 WHEN l_tax <= .02 THEN 2 WHEN l_tax <= .05 THEN 1 ELSE 0 END AS item_6 FROM lineitem"""
)
def significance_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.item_5(F.array("l_discount", "l_tax")).alias("item_5"), rules.item_6(F.col("l_tax")).alias("item_6"))


@query(
    """WITH i AS (SELECT o_orderkey, (o_orderkey % 4)::INT AS a, (o_orderkey // 4 % 4)::INT AS b, (o_orderkey // 16 % 4)::INT AS c, CASE WHEN o_custkey % 11 > 0 THEN (o_custkey % 4)::INT END AS d, (o_custkey // 4 % 4)::INT AS e, (o_custkey // 16 % 4)::INT AS f FROM orders),
    s AS (SELECT *, a + b + c + coalesce(d, 0) + e + f AS points FROM i)
    SELECT o_orderkey, points, CASE WHEN d IS NULL THEN NULL WHEN points >= 16 AND least(b, d, e, f) >= 3 AND least(a, c) >= 2 THEN 3 WHEN points >= 10 AND least(b, d, e, f) >= 2 AND least(a, c) >= 1 THEN 2 WHEN points >= 6 AND least(a, b, c, d, e, f) >= 1 THEN 1 END AS grade FROM s"""
)
def foundation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda c, by: F.pmod(F.floor(F.col(c) / by), F.lit(4)).cast("int")
    items = [digit("o_orderkey", 1), digit("o_orderkey", 4), digit("o_orderkey", 16), F.when(F.col("o_custkey") % 11 > 0, digit("o_custkey", 1)), digit("o_custkey", 4), digit("o_custkey", 16)]
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.foundation_points(items).alias("points"), rules.foundation(items).alias("grade"))


@query("SELECT p_partkey, CASE WHEN a < 0 THEN 'error' WHEN a <= 50 THEN 'classified' ELSE 'unclassified' END AS status, CASE WHEN a < 0 OR a > 50 THEN NULL WHEN a <= 30 THEN 3 WHEN a <= 40 THEN 2 ELSE 1 END AS grade FROM (SELECT p_partkey, (p_partkey % 70 - 5)::DOUBLE AS a FROM part)")
def precision_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("p_partkey") % 70 - 5).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", rules.precision_status(a).alias("status"), rules.precision(a).alias("grade"))


@query(
    """WITH c AS (SELECT p_brand, p_size, count(*) AS m FROM part GROUP BY ALL), n AS (SELECT p_brand, sum(m)::BIGINT AS n, min(m) AS least, count(*) AS k FROM c GROUP BY 1), t AS (SELECT *, CASE WHEN n <= 30 THEN 3 WHEN n <= 100 THEN ceil(n / 10) ELSE 10 END AS need FROM n)
    SELECT p_brand, n, need::BIGINT AS need, CASE WHEN n < 9 OR least < need THEN 'violated' ELSE 'met' END AS status FROM t"""
)
def micronumerosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("m"))
    own = counts.groupBy("p_brand").agg(F.sum("m").alias("n"), F.collect_list("m").alias("counts"))
    return own.select("p_brand", "n", rules.least_per_characteristic(F.col("n")).alias("need"), rules.micronumerosity(F.col("n"), F.lit(2), F.col("counts")).alias("status"))


@query(
    """SELECT o_orderkey, round(o_totalprice * .85, 4) AS arb_lower, round(o_totalprice * 1.15, 4) AS arb_upper, round(greatest(o_totalprice * .85, low), 4) AS adm_lower, round(least(o_totalprice * 1.15, high), 4) AS adm_upper
    FROM (SELECT *, o_totalprice * .8 AS low, o_totalprice * 1.1 AS high FROM orders)"""
)
def interval_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    o = read(spark, sf_dir, "orders").select("o_orderkey", rules.arbitration_field(x).alias("a"), rules.admissible_interval(x, x * 0.8, x * 1.1).alias("b"))
    return o.select("o_orderkey", r("a.lower", 4).alias("arb_lower"), r("a.upper", 4).alias("arb_upper"), r("b.lower", 4).alias("adm_lower"), r("b.upper", 4).alias("adm_upper"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= .1 THEN 'violated' ELSE 'not_rejected' END AS normality, CASE WHEN l_linenumber = 2 THEN l_linenumber END AS verified FROM lineitem")
def assumptions_and_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rules.documentary_item(F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).cast("int"), F.col("l_linenumber") == 2)
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.assumption(F.col("l_tax")).alias("normality"), given.alias("verified"))
    return out


@query("SELECT p_partkey, CASE WHEN a + b + c >= 7 AND a >= 3 AND b >= 2 AND c >= 2 THEN 3 WHEN a + b + c >= 5 AND a >= 2 AND b >= 2 THEN 2 WHEN a + b + c >= 3 AND least(a, b, c) >= 1 THEN 1 END AS grade FROM (SELECT p_partkey, (p_partkey % 4)::INT AS a, (p_partkey // 4 % 4)::INT AS b, (p_partkey // 16 % 4)::INT AS c FROM part)")
def cost_foundation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [F.pmod(F.floor(F.col("p_partkey") / by), F.lit(4)).cast("int") for by in (1, 4, 16)]
    return read(spark, sf_dir, "part").select("p_partkey", rules.cost_foundation(items).alias("grade"))


# -- batches -----------------------------------------------------------------------------------------------------------


def _frozen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, score.Frozen]:
    """A model of prices from lines of even orders below 30 units; every line is a subject."""
    li = read(spark, sf_dir, "lineitem")
    train = li.where("l_orderkey % 2 = 0 AND l_quantity <= 30")
    made = value(train, Request("l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"]))
    return li.withColumn("subject_id", F.concat_ws("-", "l_orderkey", "l_linenumber")), made.frozen


_RANGE = "(SELECT min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_discount) AS da, max(l_discount) AS db FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30)"
_INSIDE = "l_quantity BETWEEN qa * .5 AND qb * 2 AND l_discount BETWEEN da * .5 AND db * 2"


@query(f"SELECT CASE WHEN {_INSIDE} THEN 'succeeded' ELSE 'out_of_domain' END AS status, count(*) AS n FROM lineitem, {_RANGE} GROUP BY 1")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, frozen = _frozen(spark, sf_dir)
    return score.batch_summary(score.score_batch(subjects, frozen))


_BATCH = f"""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30), m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, min(x) AS lo, max(x) AS hi FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 2 * hi OR l_quantity < lo / 2 THEN 'out_of_domain' ELSE 'succeeded' END AS status, round(CASE WHEN l_quantity <= 2 * hi AND l_quantity >= lo / 2 THEN a + b * l_quantity END, 3) AS point FROM lineitem, m"""


@query(_BATCH)
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"]))
    return made.score(li).select("l_orderkey", "l_linenumber", "status", r("point", 3).alias("point"))


@query()
def batch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, frozen = _frozen(spark, sf_dir)
    out = score.score_batch(subjects, frozen)
    return out.select("subject_id", "status", *[r(c, 4).alias(c) for c in ("point", "mean_low", "mean_high", "pred_low", "pred_high", "amplitude_pct")], "item_4", "precision_grade")


@query("WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30), m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM t) SELECT l_orderkey, l_linenumber, round(b * l_quantity / (a + b * l_quantity), 5) AS elasticity_l_quantity FROM lineitem, m")
def elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"]))
    return li.select("l_orderkey", "l_linenumber", *[r(v, 5).alias(k) for k, v in score.elasticities(li, made.frozen).items()])


@query("SELECT user_id, count(*) FILTER (k = 1) AS n_first, count(*) FILTER (k > 1) AS n_repeated FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY 1")
def batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ledger.first_of_each(read(spark, sf_dir, "events"), "user_id", "event_id")
    return marked.groupBy("user_id").agg(F.count_if(~F.col("repeated")).alias("n_first"), F.count_if("repeated").alias("n_repeated"))


@query("SELECT count(*) AS n_remaining FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("cancelled").alias("status"))
    return score.remaining(read(spark, sf_dir, "customer"), earlier, "c_custkey").agg(F.count(F.lit(1)).alias("n_remaining"))


# -- cost and decisions ------------------------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT l_orderkey, l_quantity * l_extendedprice + l_tax AS amount, l_linenumber = 7 AS land, l_linenumber = 6 AS gone FROM lineitem) SELECT l_orderkey, round(sum(amount) FILTER (NOT land AND NOT gone), 2) AS direct, round(coalesce(sum(amount) FILTER (land), 0), 2) AS land, count(*) FILTER (NOT land AND NOT gone) AS n_items,
    round(sum(amount) FILTER (NOT land AND NOT gone) * 1.2 * .9 + coalesce(sum(amount) FILTER (land), 0), 2) AS point FROM i WHERE NOT gone GROUP BY 1"""
)
def cost_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    items = li.select("l_orderkey", F.when(F.col("l_linenumber") == 7, "land").when(F.col("l_linenumber") == 6, "excluded").otherwise("component").alias("category"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_cost"), F.col("l_tax").alias("additional_expenses"), F.lit("table").alias("source"), F.lit("BRL").alias("currency"), F.lit("2024-01-01").alias("reference_date"), F.lit("X").alias("location"), F.lit(True).alias("include_land"))
    out = cost.reconstruction_costs(items, "l_orderkey", F.lit(0.2), F.lit(0.1), "BRL", "2024-01-01", "X", depreciated=True)
    return out.select("l_orderkey", F.when(F.col("n_items") > 0, r("direct", 2)).alias("direct"), r("land", 2).alias("land"), "n_items", r("point", 2).alias("point"))


@query("SELECT p_partkey, round((1 + a) * (1 + b) - 1, 9) AS compound, round(a + b, 9) AS additive, false AS matches FROM (SELECT p_partkey, p_size / 100 AS a, .05 AS b FROM part)")
def bdi_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.array(F.col("p_size") / 100, F.lit(0.05))
    return read(spark, sf_dir, "part").select("p_partkey", r(cost.compound(rates), 9).alias("compound"), r(cost.additive(rates), 9).alias("additive"), cost.bdi_matches(cost.additive(rates), rates, F.lit("compound")).alias("matches"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 3 = 1 THEN (p_size / 100)::DOUBLE END AS rate FROM part")
def depreciation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("new_asset"), F.lit("recovery_cost"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", cost.depreciation_rate(mode, F.lit(None).cast("double"), F.col("p_size").cast("double"), F.lit(100.0)).alias("rate"))


@query("SELECT event_type AS code, min(user_id % 5)::BIGINT AS priority, count(DISTINCT user_id)::INT AS n_refs FROM events GROUP BY 1")
def actions_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 5).alias("priority"), F.col("user_id").cast("string").alias("reference"), F.col("event_type").alias("reason"))
    return ledger.consolidate_actions(e).select("code", "priority", F.col("n_refs").cast("int").alias("n_refs"))


@query("SELECT DISTINCT event_type AS code, CAST(user_id AS VARCHAR) AS reference FROM events WHERE user_id IS NOT NULL")
def actions_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("reference"))
    return ledger.action_references(e)


@query("SELECT n_name AS component, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'present' WHEN n_regionkey = 0 THEN 'missing' ELSE 'optional_missing' END AS status FROM nation")
def output_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    due = n.select(F.col("n_name").alias("component"), (F.col("n_regionkey") == 0).alias("mandatory"))
    there = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("component"))
    return ledger.conformance(due, there).select("component", "status")


@query("SELECT CASE WHEN min(o_totalprice) <> max(o_totalprice) THEN 'review_value_sensitivity' END AS action FROM orders")
def alternatives_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.lit("BRL").alias("unit"), F.lit("2024-01-01").alias("date"), F.lit("mean").alias("estimand"), F.col("o_totalprice").alias("value"))
    return ledger.comparable_alternatives(o)


# -- the whole procedure in folds, targets' logarithms, saved projects ---------------------------------------------------


@query(
    """WITH f AS (SELECT l_orderkey % 5 AS fold, l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem),
    g AS (SELECT fold, y, 'l_quantity' AS name, a AS x FROM f UNION ALL SELECT fold, y, 'l_discount', b FROM f UNION ALL SELECT fold, y, 'l_tax', c FROM f),
    m AS (SELECT k AS fold, name, regr_intercept(y, x) AS i, regr_slope(y, x) AS s, sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*)) AS rmse, avg(y) AS mean, count(*) AS n_train FROM g, range(5) t(k) WHERE fold <> k GROUP BY k, name),
    best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rmse, name) = 1),
    e AS (SELECT f.fold, y, mean, n_train, name, i + s * CASE name WHEN 'l_quantity' THEN a WHEN 'l_discount' THEN b ELSE c END AS p FROM f JOIN best USING (fold))
    SELECT fold::INT AS fold, count(*) AS n_reserved, count(*) AS n_scored, any_value(n_train) AS n_train, any_value(name) || ':linear|y:identity|int:1' AS candidate_id, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(mean - y)), 4) AS mean_mae FROM e GROUP BY fold"""
)
def procedure_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = resample.evaluate_selection(_kfold(spark, sf_dir), "fold", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], [], policy=1, options=("linear",))
    return out.select("fold", "n_reserved", "n_scored", "n_train", "candidate_id", r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"), r("mean_mae", 4).alias("mean_mae"))


@query("SELECT l_returnflag AS fold, count(*) AS n_reserved, 0::BIGINT AS n_scored, (SELECT count(*) FROM lineitem) - count(*) AS n_train FROM lineitem GROUP BY 1")
def procedure_unseen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold holds the only rows of a level: a model that uses the level can't score them."""
    li = read(spark, sf_dir, "lineitem").withColumn("fold", F.col("l_returnflag"))
    out, _ = resample.evaluate_selection(li, "fold", "l_extendedprice", [], ["l_returnflag"], options=("linear",))
    return out.select("fold", "n_reserved", "n_scored", "n_train")


_LOG_SEARCH = " UNION ALL ".join(
    f"SELECT 'size:{o}|y:identity|int:1' AS candidate_id, sqrt(avg((i + s * {e} - y) * (i + s * {e} - y))) AS rmse FROM p, (SELECT regr_intercept(y, {e}) AS i, regr_slope(y, {e}) AS s FROM p) UNION ALL SELECT 'size:{o}|y:log|int:1', sqrt(avg((exp(i + s * {e}) - y) * (exp(i + s * {e}) - y))) FROM p, (SELECT regr_intercept(ln(y), {e}) AS i, regr_slope(ln(y), {e}) AS s FROM p)"
    for o, e in _OPTION.items()
)


@query(f"WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS ({_LOG_SEARCH}) SELECT candidate_id, round(rmse, 5) AS rmse FROM c")
def search_log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), "p_retailprice")
    found = search.search_models(p, "p_retailprice", search.units_of(p, ["size"]), targets=("identity", "log"))
    return found.records.select("candidate_id", r("rmse", 5).alias("rmse"))


_LINES = "WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30), m AS (SELECT regr_intercept(ln(y), x) AS a, regr_slope(ln(y), x) AS b, min(x) AS lo, max(x) AS hi, regr_syy(ln(y), x) * (1 - regr_r2(ln(y), x)) / (count(*) - 2) AS v FROM t), q AS (SELECT avg(exp(ln(y) - a - b * x)) AS f FROM t, m)"


def _log_point(estimand: str, factor: str) -> None:
    @query(f"{_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 2 * hi OR l_quantity < lo / 2 THEN 'out_of_domain' ELSE 'succeeded' END AS status, round(CASE WHEN l_quantity <= 2 * hi AND l_quantity >= lo / 2 THEN exp(a + b * l_quantity) * {factor} END, 2) AS point FROM lineitem, m, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = read(spark, sf_dir, "lineitem")
        made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"], transform="log", estimand=estimand))
        return made.score(li).select("l_orderkey", "l_linenumber", "status", r("point", 2).alias("point"))

    name = f"batch_log_{estimand}"
    for d in (QUERIES, SQL):
        d[name] = d.pop("run")


for _estimand, _factor in (("median", "1"), ("lognormal_mean", "exp(v / 2)"), ("smearing", "f")):
    _log_point(_estimand, _factor)


@query(_BATCH)
def frozen_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a project that was saved as text and loaded again."""
    li = read(spark, sf_dir, "lineitem")
    made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"]))
    return score.score_batch(li, score.Frozen.loads(made.frozen.dumps())).select("l_orderkey", "l_linenumber", "status", r("point", 3).alias("point"))


# a level's own mean and slopes within levels give the same model as indicators; t by its expansion around the normal quantile
@query(
    f"""WITH t AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30),
    c AS (SELECT g, count(*) AS n, avg(x) AS x, avg(z) AS z, avg(y) AS y FROM t GROUP BY g),
    w AS (SELECT sum((t.x - c.x) ** 2) AS xx, sum((t.z - c.z) ** 2) AS zz, sum((t.x - c.x) * (t.z - c.z)) AS xz, sum((t.x - c.x) * (t.y - c.y)) AS xy, sum((t.z - c.z) * (t.y - c.y)) AS zy, sum((t.y - c.y) ** 2) AS yy, count(*) - (SELECT count(*) FROM c) - 2 AS df FROM t JOIN c USING (g)),
    b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, xx * zz - xz * xz AS det, 1.2815515655446004 AS q FROM w),
    s AS (SELECT *, sqrt((yy - bx * xy - bz * zy) / df) * (q + (q ** 3 + q) / (4 * df) + (5 * q ** 5 + 16 * q ** 3 + 3 * q) / (96 * df ** 2) + (3 * q ** 7 + 19 * q ** 5 + 17 * q ** 3 - 15 * q) / (384 * df ** 3)) AS ts FROM b),
    p AS (SELECT l_orderkey, l_linenumber, c.y + bx * (l_quantity - c.x) + bz * (l_discount - c.z) AS point, 1 / c.n + ((l_quantity - c.x) ** 2 * zz + (l_discount - c.z) ** 2 * xx - 2 * (l_quantity - c.x) * (l_discount - c.z) * xz) / det AS h, ts, {_INSIDE} AS ok
      FROM lineitem l JOIN c ON l.l_returnflag = c.g, s, {_RANGE})
    SELECT l_orderkey, l_linenumber, round(CASE WHEN ok THEN point END, 0) AS point, round(CASE WHEN ok THEN point - ts * sqrt(h) END, 0) AS mean_low, round(CASE WHEN ok THEN point + ts * sqrt(h) END, 0) AS mean_high, round(CASE WHEN ok THEN point - ts * sqrt(1 + h) END, 0) AS pred_low, round(CASE WHEN ok THEN point + ts * sqrt(1 + h) END, 0) AS pred_high FROM p"""
)
def batch_interval_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, frozen = _frozen(spark, sf_dir)
    out = score.score_batch(subjects, frozen)
    return out.select("l_orderkey", "l_linenumber", *[r(c, 0).alias(c) for c in ("point", "mean_low", "mean_high", "pred_low", "pred_high")])


@query("SELECT concat_ws(',', CASE WHEN l_quantity NOT BETWEEN 5 AND 20 THEN 'l_quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag' END) AS outside, count(*) AS n FROM lineitem GROUP BY 1")
def declared_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, frozen = _frozen(spark, sf_dir)
    frozen.domain = {"l_quantity": (5.0, 20.0), "l_returnflag": ["A", "N"]}
    return score.score_batch(subjects, frozen).groupBy(F.concat_ws(",", "outside_domain").alias("outside")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag = 'R' AS meets, count(*) AS n FROM lineitem GROUP BY 1")
def subject_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, frozen = _frozen(spark, sf_dir)
    frozen.scope, frozen.subject = "subject_specific", {"l_returnflag": "R"}
    return score.score_batch(subjects, frozen).groupBy((F.size("outside_domain") == 0).alias("meets")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT field, true AS agrees, count(*) AS n FROM part, (VALUES ('point'), ('mean_low'), ('mean_high'), ('pred_low'), ('pred_high')) t(field) GROUP BY 1, 2")
def reproduced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("subject_id", F.col("p_partkey").cast("string"))
    made = value(p.where("p_partkey % 2 = 0"), Request("p_retailprice", ["p_size"], ["p_brand"]))
    out = score.reproduced(made.score(p), p, score.Frozen.loads(made.frozen.dumps()))
    return out.groupBy("field", "agrees").agg(F.count(F.lit(1)).alias("n"))


# -- from a source to values ------------------------------------------------------------------------------------------------


def _ingested(spark: SparkSession, sf_dir: str) -> Ingested:
    """All lines as a Brazilian spreadsheet's text: some prices are missing, malformed, infinite or words."""
    li = read(spark, sf_dir, "lineitem")
    comma = lambda x: F.translate(F.format_number(x, 2), ",.", ".,")
    odd = F.col("l_orderkey") % 10
    price = F.when(odd == 0, "n/a").when(odd == 1, "1.2.3").when(odd == 2, "inf").when(odd == 3, "a combinar").otherwise(F.concat(F.lit("R$ "), comma(F.col("l_extendedprice"))))
    text = lambda c, name: F.col(c).cast("string").alias(name)
    sheet = li.select(text("l_orderkey", "Pedido"), text("l_linenumber", "Linha"), price.alias("Preço Total"), comma(F.col("l_quantity")).alias("Quantidade (un.)"), F.col("l_returnflag").alias("Tipo"), F.concat(F.lit("0"), F.col("l_linenumber").cast("string")).alias("Código"))
    path = f"{shared_dir(spark)}/sheet-{uuid.uuid4().hex}"
    tabular.write_csv(sheet, path)
    source = Source("Preço Total", {"Pedido": "identifier", "Linha": "identifier", "Tipo": "predictor", "Bairro": "predictor"}, ["Quantidade (un.)", "Código"], "pt-BR")
    return ingest_csv(spark, path, source)


_FORMS = "CASE l_orderkey % 10 WHEN 0 THEN 'missing_target' WHEN 1 THEN 'malformed_number,unusable_target' WHEN 2 THEN 'non_finite_value,non_finite_target' WHEN 3 THEN 'unusable_target' ELSE '' END"


@query(
    f"""WITH t AS (SELECT *, l_orderkey % 10 > 3 AS used FROM lineitem), m AS (SELECT regr_intercept(round(l_extendedprice, 2), l_quantity) AS a, regr_slope(round(l_extendedprice, 2), l_quantity) AS b FROM t WHERE used)
    SELECT l_orderkey, l_linenumber, {_FORMS} AS reasons, CASE WHEN used THEN 'observed' WHEN l_orderkey % 10 IN (0, 3) THEN 'pending_target' ELSE 'rejected' END AS disposition,
      CASE WHEN used THEN round(l_extendedprice, 2) END AS target, round(a + b * l_quantity, 3) AS point FROM t, m"""
)
def ingest_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a file of Brazilian texts to a model and values of all its rows."""
    found = _ingested(spark, sf_dir)
    made = found.valued(Request("", ["quantidade_un"], locale="pt-BR"))
    out = made.score(found.rows)
    return out.select(F.col("pedido").cast("bigint").alias("l_orderkey"), F.col("linha").cast("bigint").alias("l_linenumber"), F.concat_ws(",", "reasons").alias("reasons"), "disposition", r("target_value", 2).alias("target"), r("point", 3).alias("point"))


@query(
    """SELECT 'preço_total' AS "column", 'Preço Total' AS original, 'parse_numeric' AS action, count(*) AS n, round(sum(round(l_extendedprice, 2)), 2) AS total FROM lineitem WHERE l_orderkey % 10 > 3
    UNION ALL SELECT 'preço_total', 'Preço Total', CASE l_orderkey % 10 WHEN 1 THEN 'malformed_unconverted' ELSE 'non_finite_rejected' END, count(*), NULL FROM lineitem WHERE l_orderkey % 10 IN (1, 2) GROUP BY 3
    UNION ALL SELECT 'quantidade_un', 'Quantidade (un.)', 'parse_numeric', count(*), sum(l_quantity) FROM lineitem"""
)
def ingest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading did to the cells of each column; texts of codes and names stay."""
    return _ingested(spark, sf_dir).changes().groupBy("column", F.col("original_column").alias("original"), "action").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


# the student's quantile by its expansion around the normal one
@query(
    """WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0),
    m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n, count(*) - 2 AS df, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse FROM t),
    s AS (SELECT *, sqrt(sse / df) * (q + (q ** 3 + q) / (4 * df) + (5 * q ** 5 + 16 * q ** 3 + 3 * q) / (96 * df ** 2)) AS ts FROM m, (VALUES (0.8, 1.2815515655446004), (0.95, 1.959963984540054)) v(level, q))
    SELECT CAST(level AS DOUBLE) AS level, l_orderkey, l_linenumber, round(a + b * l_quantity - ts * sqrt(1 / n + (l_quantity - mx) ** 2 / sxx), 2) AS mean_low, round(a + b * l_quantity + ts * sqrt(1 + 1 / n + (l_quantity - mx) ** 2 / sxx), 2) AS pred_high FROM lineitem, s"""
)
def interval_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one model at the levels of two requests; the second project was saved and loaded."""
    li = read(spark, sf_dir, "lineitem")
    out = []
    for level in (0.8, 0.95):
        frozen = value(li.where("l_orderkey % 2 = 0"), Request("l_extendedprice", ["l_quantity"], level=level)).frozen
        frozen = frozen if level == 0.8 else score.Frozen.loads(frozen.dumps())
        out.append(score.score_batch(li, frozen).select(F.lit(level).alias("level"), "l_orderkey", "l_linenumber", r("mean_low", 2).alias("mean_low"), r("pred_high", 2).alias("pred_high")))
    return out[0].unionByName(out[1])


def _quantile(q: str) -> str:
    return f"({q} + ({q} ** 3 + {q}) / (4 * df) + (5 * {q} ** 5 + 16 * {q} ** 3 + 3 * {q}) / (96 * df ** 2))"


_STEPS = lambda limits: "CASE " + " ".join(f"WHEN t >= {_quantile(q)} THEN {g}" for g, q in zip((3, 2, 1), limits, strict=True)) + " ELSE 0 END"


# one variable a candidate: t of the slope decides items 5 and 6
@query(
    "WITH s AS (SELECT l_extendedprice AS y, l_quantity AS a, least(l_quantity, 25) AS b, l_tax AS c FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30), c AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS v, {x0}::DOUBLE AS x0, regr_intercept(y, {x}) AS i, regr_slope(y, {x}) AS m, avg({x}) AS mx, regr_sxx(y, {x}) AS sxx, count(*) AS n, count(*) - 2 AS df, regr_syy(y, {x}) - regr_sxy(y, {x}) ** 2 / regr_sxx(y, {x}) AS sse, min({x}) AS lo, max({x}) AS hi FROM s" for name, x, x0 in (("capped", "b", 25), ("quantity", "a", 40), ("tax", "c", 0.04)))
    + f"""), p AS (SELECT *, i + m * x0 AS point, {_quantile('1.2815515655446004')} * sqrt(sse / df * (1 / n + (x0 - mx) ** 2 / sxx)) AS half, abs(m) / sqrt(sse / df / sxx) AS t, i + m * greatest(least(x0, hi), lo) AS edge FROM c),
    g AS (SELECT *, 200 * half / abs(point) AS amplitude, CASE WHEN x0 BETWEEN lo AND hi THEN 3 WHEN x0 NOT BETWEEN lo / 2 AND hi * 2 THEN 0 WHEN abs(point - edge) / abs(edge) <= .15 THEN 2 WHEN abs(point - edge) / abs(edge) <= .2 THEN 1 ELSE 0 END AS i4,
      {_STEPS(("1.6448536269514722", "1.2815515655446004", "1.0364333894937898"))} AS i5, {_STEPS(("2.5758293035489004", "2.3263478740408408", "1.959963984540054"))} AS i6 FROM p),
    f AS (SELECT *, CASE WHEN 9 + i4 + i5 + i6 >= 16 AND least(i4, i5, i6) >= 3 THEN 3 WHEN 9 + i4 + i5 + i6 >= 10 AND least(i4, i5, i6) >= 2 THEN 2 WHEN 9 + i4 + i5 + i6 >= 6 AND least(i4, i5, i6) >= 1 THEN 1 END AS grade FROM g)
    SELECT v || ':linear|y:identity|int:1' AS candidate_id, grade, coalesce(grade >= 2, false) AS framing, round(point, 4) AS point, round(amplitude, 6) AS amplitude, row_number() OVER (ORDER BY coalesce(grade >= 2, false) DESC, sse)::INT AS rank FROM f"""
)
def search_for_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject beyond the sample's quantities: the best fit extrapolates too far, so that a framed candidate wins before it."""
    li = read(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0 AND l_quantity <= 30")
    sample = li.select("l_extendedprice", F.col("l_quantity").alias("quantity"), F.least("l_quantity", F.lit(25)).alias("capped"), F.col("l_tax").alias("tax"))
    subject = spark.createDataFrame([(40.0, 25.0, 0.04)], "quantity double, capped double, tax double")
    units = [search.Unit(c, ("linear",)) for c in ("quantity", "capped", "tax")]
    found = search.search_models(sample, "l_extendedprice", units, policy=1, subject=subject, frame=search.Policy(least_grade=2, documents=(3, 3), require_precision=True))
    return found.records.select("candidate_id", "grade", "framing", r("point", 4).alias("point"), r("amplitude_pct", 6).alias("amplitude"), "rank")


@query(
    """WITH f AS (SELECT unnest(['point', 'mean_low', 'mean_high', 'pred_low', 'pred_high']) AS field), k AS (SELECT unnest(['end', 'coefficient']) AS tampered)
    SELECT tampered, field, CASE WHEN tampered = 'coefficient' THEN false ELSE NOT (field = 'mean_high' AND p_partkey % 10 = 0) END AS agrees, count(*) AS n FROM part, f, k GROUP BY ALL"""
)
def reproduced_independently(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values against their own model by joins: every tenth upper end was changed, then, in another folder, a coefficient."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("subject_id"), "p_size", "p_brand", "p_retailprice")
    made = value(p, Request("p_retailprice", ["p_size"], ["p_brand"]))
    scored = made.score(p.withColumn("raw", F.struct("p_size", "p_brand")))
    out = []
    for kind in ("end", "coefficient"):
        path = f"{shared_dir(spark)}/disclosed-{uuid.uuid4().hex}"
        high = F.col("mean_high")
        reproduce.store(scored.withColumn("mean_high", F.when(F.col("subject_id").cast("bigint") % 10 == 0, high * 1.001).otherwise(high)) if kind == "end" else scored, made.frozen, path)
        if kind == "coefficient":
            terms = spark.createDataFrame(spark.read.parquet(f"{path}/terms").collect(), "term string, beta double, variable string, level string")  # a row a term
            terms.withColumn("beta", F.when(F.col("term") == "p_size", F.col("beta") + 0.01).otherwise(F.col("beta"))).write.mode("overwrite").parquet(f"{path}/terms")
        out.append(reproduce.reproduce(spark, path).groupBy(F.lit(kind).alias("tampered"), "field", "agrees").agg(F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1])


@query(_BATCH)
def batch_cancel_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that was cancelled after three of its slices, and taken up again: each line has one result."""
    li = read(spark, sf_dir, "lineitem").withColumn("subject_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    frozen = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"])).frozen
    path = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    batch.run_batch(li, frozen, path, slices=6, cancelled=lambda done: done == 3)
    batch.run_batch(li, frozen, path, slices=6)
    return batch.results(spark, path).select("l_orderkey", "l_linenumber", "status", r("point", 3).alias("point"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM events), h AS (SELECT n, round_even(n * .25, 0)::BIGINT AS t FROM n), f AS (SELECT n, unnest(range(7)) AS fold FROM n)
    SELECT 'holdout' AS kind, 'test' AS part, t AS n FROM h UNION ALL SELECT 'holdout', 'train', n - t FROM h UNION ALL SELECT 'folds', fold::VARCHAR, n // 7 + (fold < n % 7)::INT FROM f"""
)
def exact_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an exact hold-out of a quarter, and of seven folds."""
    e = read(spark, sf_dir, "events").select("event_id")
    sizes = lambda d, kind, part: d.groupBy(F.lit(kind).alias("kind"), F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return sizes(resample.exact_holdout(e, "event_id", 0.25, 7), "holdout", "role").unionByName(sizes(resample.exact_folds(e, "event_id", 7, 7), "folds", "fold"))


@query(
    """WITH g AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), f AS (SELECT n, unnest(range(6)) AS fold FROM g)
    SELECT fold::INT AS fold, n // 6 + (fold < n % 6)::INT AS n_groups, 0::BIGINT AS n_split FROM f"""
)
def exact_group_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of six folds of orders by customer, and how many groups lie in several folds."""
    placed = resample.exact_group_folds(read(spark, sf_dir, "orders"), "o_custkey", 6, 3)
    each = placed.groupBy("o_custkey").agg(F.min("fold").alias("fold"), F.count_distinct("fold").alias("folds"))
    return each.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("folds") > 1).alias("n_split"))


@query(
    """WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part), m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2)) AS s FROM p),
    e AS (SELECT unnest(['residual', 'standardized']) AS measure, unnest([y - a - b * x, (y - a - b * x) / s]) AS e FROM p, m), c AS (SELECT measure, min(e) AS lo, max(e) AS hi, ceil(log2(count(*)))::INT + 1 AS k FROM e GROUP BY measure),
    n AS (SELECT e.measure, least(floor((e - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS n FROM e JOIN c USING (measure) GROUP BY 1, 2)
    SELECT c.measure, bin, round(lo + bin * (hi - lo) / k, 6) AS low, coalesce(n, 0) AS n FROM (SELECT measure, lo, hi, k, unnest(range(k)) AS bin FROM c) c LEFT JOIN n USING (measure, bin)"""
)
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, fit = _simple(spark, sf_dir)
    return regress.residual_tables(p, fit, "y")[0].select("measure", "bin", r("low").alias("low"), "n")


@query(
    """WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part), m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p), e AS (SELECT a + b * x AS f, y - a - b * x AS e FROM p, m),
    c AS (SELECT min(f) AS fl, max(f) AS fh, min(e) AS el, max(e) AS eh FROM e)
    SELECT sum(n)::BIGINT AS n_rows, max(residual_bin)::INT AS top, count(DISTINCT residual_bin) AS residual_bins FROM (SELECT least(floor((e - el) / ((eh - el) / 20)), 19) AS residual_bin, count(*) AS n FROM e, c GROUP BY 1)"""
)
def residual_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid behind a plot of residuals over fitted values, by its margins."""
    p, fit = _simple(spark, sf_dir)
    grid = regress.residual_tables(p, fit, "y")[1]
    return grid.agg(F.sum("n").alias("n_rows"), F.max("residual_bin").alias("top"), F.count_distinct("residual_bin").alias("residual_bins"))


@query()
def transform_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normality of every transform of two columns of all parts' sample."""
    return regress.transform_diagnostics(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


# two weighted replicates, the sample without the listed rows, and two copies that move by a known share
@query(
    """WITH p AS (SELECT p_partkey AS id, p_retailprice AS y, p_size::DOUBLE AS x FROM part), w AS (SELECT *, unnest(['base', 'r0', 'r1', 'revision']) AS k, unnest([1, id % 3, (id + 1) % 3, (id % 11 > 0)::INT]) AS w FROM p),
    s AS (SELECT k, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS sxy, sum(w * x * x) - sum(w * x) ** 2 / sum(w) AS sxx FROM w GROUP BY k),
    m AS (SELECT max(sxy / sxx) FILTER (k = 'base') AS b, max(my - sxy / sxx * mx) FILTER (k = 'base') AS a, max(sxy / sxx) FILTER (k = 'r0') AS b0, max(my - sxy / sxx * mx) FILTER (k = 'r0') AS a0, max(sxy / sxx) FILTER (k = 'r1') AS b1, max(my - sxy / sxx * mx) FILTER (k = 'r1') AS a1, max(sxy / sxx) FILTER (k = 'revision') AS b2, max(my - sxy / sxx * mx) FILTER (k = 'revision') AS a2 FROM s)
    SELECT id, round((a0 + b0 * x + a1 + b1 * x) / 2, 4) AS replicates_mean, round(abs(a0 + b0 * x - a1 - b1 * x) / sqrt(2), 4) AS replicates_sd, round(greatest(a + b * x * 1.01, a + b * x * .98), 4) AS copies_max, round(a2 + b2 * x - a - b * x, 4) AS revision_change FROM p, m"""
)
def stability_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates, perturbed copies and a revision of one sample, from one pass and a projection."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))
    out, _ = resample.stability(p, "id", "y", ["x"], 2, 2, 17, removed=p.where("id % 11 = 0"), weights=[F.col("id") % 3, (F.col("id") + 1) % 3], noise=[{"x": F.lit(0.01)}, {"x": F.lit(-0.02)}])
    return out.select("id", *[r(c, 4).alias(c) for c in ("replicates_mean", "replicates_sd", "copies_max", "revision_change")])


@query(f"SELECT *, true AS hit, false AS other_target_hit FROM ({_EXACT})")
def search_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is made once; the second time it comes from its folder, and a sample that can't be read doesn't matter. Another target is another search."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    folder, units = f"{shared_dir(spark)}/searches-{uuid.uuid4().hex}", search.units_of(p, ["size"])
    name = cache.sample_fingerprint(p, "p_partkey", ["size", "p_retailprice"])
    cache.cached_search(p, "p_retailprice", units, folder, name)
    found, hit = cache.cached_search(p.withColumn("size", F.raise_error(F.lit("a row was read")).cast("double")), "p_retailprice", units, folder, name)
    _, other = cache.cached_search(p, "p_partkey", units, folder, name)
    return found.records.select("candidate_id", r("rmse").alias("rmse"), "rank", F.lit(hit).alias("hit"), F.lit(other).alias("other_target_hit"))


@query(
    """WITH q AS (SELECT o_orderkey, o_custkey AS id, o_orderkey % 2 AS v, CASE o_orderkey % 3 WHEN 0 THEN 15.0 WHEN 1 THEN 20.0 END AS said, o_totalprice AS point FROM orders),
    p AS (SELECT c_custkey AS id, 0 AS v, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 5 > 0 AS good FROM customer),
    j AS (SELECT q.*, coalesce(good, false) AS good FROM q LEFT JOIN p USING (id, v))
    SELECT o_orderkey, CASE WHEN NOT good AND said IS NOT NULL THEN 'rejected_unverified_or_inapplicable_profile' WHEN NOT good THEN 'arbitration_rule_unverified' WHEN said <> 15 THEN 'arbitration_policy_conflict' ELSE 'applied_verified_profile_rule' END AS status,
      CASE WHEN good AND coalesce(said, 15) = 15 THEN round(point * .85, 4) END AS lower FROM j"""
)
def arbitration_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitration fields of all orders under the profiles of their customers, of which some are verified."""
    c = read(spark, sf_dir, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.lit(0).alias("version"), F.when(F.col("c_custkey") % 5 > 0, policy.VERIFIED).otherwise("draft").alias("state"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), policy.METHOD).otherwise("cost").alias("method"), F.lit(policy.BASIS).alias("value_basis"), F.lit("s").alias("source_sha256"))
    k = F.col("o_orderkey")
    asked = read(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("profile_id"), (k % 2).cast("int").alias("profile_version"), F.when(k % 3 == 0, 15.0).when(k % 3 == 1, 20.0).alias("declared_percent"), "o_totalprice")
    out = policy.arbitration(asked, known)
    return out.select("o_orderkey", F.col("arbitration_status").alias("status"), r(policy.arbitration_ends(F.col("o_totalprice"), F.col("arbitration_percent"))["lower"], 4).alias("lower"))


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 END AS b FROM part)
    SELECT p_partkey, CASE WHEN NOT coalesce(a BETWEEN 1 AND 3, true) OR NOT coalesce(b BETWEEN 1 AND 3, true) OR a <> b THEN NULL ELSE coalesce(a, b)::INT END AS grade,
      CASE WHEN NOT coalesce(a BETWEEN 1 AND 3, true) OR NOT coalesce(b BETWEEN 1 AND 3, true) THEN 'grade_invalid' WHEN a <> b THEN 'GRADE_ALIAS_CONFLICT' END AS code FROM p"""
)
def least_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least grade of requests that name it under two of its historical names."""
    k = F.col("p_partkey")
    asked = read(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, k % 5).alias("minimum_fundamentacao_grade"), F.when(k % 3 == 0, (k % 4).cast("string")).alias("target_degree"))
    return asked.select("p_partkey", policy.least_grade(asked).alias("x")).select("p_partkey", "x.grade", "x.code")


@query(
    """WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 30),
    f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, min(x) AS lo, max(x) AS hi, count(*) - 2 AS df, abs(regr_slope(y, x)) / sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM t),
    m AS (SELECT *, """
    + _STEPS(("1.6448536269514722", "1.2815515655446004", "1.0364333894937898"))
    + " AS i5, "
    + _STEPS(("2.5758293035489004", "2.3263478740408408", "1.959963984540054"))
    + """ AS i6 FROM f),
    s AS (SELECT l_orderkey, l_linenumber, i5, i6, l_quantity BETWEEN lo / 2 AND hi * 2 AS ok, CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber % 4 END AS i1, CASE WHEN l_quantity BETWEEN lo AND hi THEN 3 WHEN abs(b * (l_quantity - edge)) / abs(a + b * edge) <= .15 THEN 2 WHEN abs(b * (l_quantity - edge)) / abs(a + b * edge) <= .2 THEN 1 ELSE 0 END AS i4 FROM (SELECT *, greatest(least(l_quantity, hi), lo) AS edge FROM lineitem, m)),
    p AS (SELECT *, coalesce(i1, 0) + i4 + 5 + i5 + i6 AS points, least(i4, i5, i6) AS worst FROM s),
    g AS (SELECT *, CASE WHEN NOT ok OR i1 IS NULL THEN NULL WHEN worst >= 3 AND i1 >= 2 AND points >= 16 THEN 3 WHEN worst >= 2 AND i1 >= 1 AND points >= 10 THEN 2 WHEN worst >= 1 AND i1 >= 1 AND points >= 6 THEN 1 END AS grade FROM p)
    SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN points END AS points, CASE WHEN ok THEN CASE WHEN i1 IS NULL THEN 'item_1' ELSE '' END END AS pending, grade AS foundation_grade, CASE WHEN grade IS NULL THEN 'pending' WHEN grade >= 2 THEN 'met' ELSE 'not_met' END AS requirement FROM g"""
)
def assessed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foundation of every line's value: the model's items, the line's own extrapolation and its documents, of which some aren't verified."""
    li = read(spark, sf_dir, "lineitem")
    made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"]))
    document = rules.documentary_item((F.col("l_linenumber") % 4).cast("int"), F.col("l_orderkey") % 3 > 0)
    out = assess(made.score(li), made.grades, document, F.lit(2), F.lit(2))
    return out.select("l_orderkey", "l_linenumber", "points", F.when(F.col("pending").isNotNull(), F.concat_ws(",", "pending")).alias("pending"), "foundation_grade", F.col("foundation_requirement").alias("requirement"))


# -- rows by id, summaries, rules ----------------------------------------------------------------------------------------


@query("SELECT o_custkey AS c_custkey, o_orderkey AS position, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0")
def rows_in_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return records.select_in_order(read(spark, sf_dir, "customer"), ids, "c_custkey", "o_orderkey").select("c_custkey", "position", "c_name")


@query("SELECT k AS c_custkey, c_name, c_name IS NOT NULL AS present FROM (SELECT c_custkey * 2 AS k FROM customer) LEFT JOIN customer ON k = c_custkey")
def rows_for_every_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return records.rows_for_ids(c, c.select((F.col("c_custkey") * 2).alias("c_custkey")), "c_custkey").select("c_custkey", "c_name", "present")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return records.feature_records(p, ids, "p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS used, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) AS index FROM orders")
def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("used"))
    return records.report_index(o, "used", "o_orderkey").select("o_orderkey", "used", "index")


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN n_regionkey = 1 THEN 'missing' ELSE 'observed' END AS disposition FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def original_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    notes = n.select("n_nationkey", F.when(F.col("n_regionkey") == 1, "missing").otherwise("observed").alias("disposition"))
    ids = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return records.original_record(n, notes, ids, "n_nationkey").select("n_nationkey", F.col("values")["n_name"].alias("name"), F.col("values")["n_regionkey"].alias("region"), "disposition")


@query("SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS before, lower(c_mktsegment) AS after FROM customer UNION ALL SELECT c_custkey, 'c_name', c_name, NULL FROM customer WHERE c_custkey % 4 = 0")
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    after = c.withColumns({"c_mktsegment": F.lower("c_mktsegment"), "c_name": F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))})
    return records.changed_cells(c, after, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    """WITH p AS (SELECT p_partkey, p_retailprice AS y, p_size::DOUBLE AS x FROM part), s AS (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2) AS v FROM p),
    h AS (SELECT *, 1 / n + (x - mx) * (x - mx) / sxx AS lev, y - a - b * x AS e FROM p, s), f AS (SELECT lev > 4 / n AS l, abs(e) / sqrt(v * (1 - lev)) > 2.5 AS r, e * e * lev / (2 * v * (1 - lev) * (1 - lev)) > least(4 / n, 1) AS k, p_partkey % 2 = 0 AS said FROM h)
    SELECT count(*) FILTER (k) AS n_cook, count(*) FILTER (r) AS n_residual, count(*) FILTER (l) AS n_leverage, count(*) FILTER (k OR r OR l) AS n_union, 0::BIGINT AS n_incomplete, count(*) FILTER ((k OR r OR l) <> said) AS n_differing, false AS union_valid FROM f"""
)
def influence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _simple(spark, sf_dir)
    return records.influence_audit(regress.influence(p, f, "y"), p.where("p_partkey % 2 = 0"), "p_partkey")


@query("SELECT 'engine' AS origin, event_type AS code, CAST(user_id % 3 AS VARCHAR) AS message, CAST(user_id AS VARCHAR) AS affected_id, count(DISTINCT user_id) OVER (PARTITION BY event_type, user_id % 3) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)")
def issue_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return records.grouped_ids(e.select(F.lit("engine").alias("origin"), F.col("event_type").alias("code"), (F.col("user_id") % 3).cast("string").alias("message"), F.col("user_id").cast("string").alias("affected_id")))


@query(
    """SELECT 'o_orderpriority' AS "column", count(*) AS n_rows, 0::BIGINT AS n_missing, count(DISTINCT o_orderpriority) AS n_distinct, false AS identification, '' AS warnings FROM orders
    UNION ALL SELECT 'o_orderkey', count(*), 0, count(DISTINCT o_orderkey), true, '' FROM orders UNION ALL SELECT 'label', count(*), count(*) FILTER (o_orderkey % 5 = 0), count(DISTINCT o_custkey) FILTER (o_orderkey % 5 > 0), false, 'high_cardinality' FROM orders"""
)
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("c"), "o_custkey")).otherwise("N/A"))
    return profile.column_summary(o, ["o_orderpriority", "o_orderkey", "label"]).withColumn("warnings", F.concat_ws(",", "warnings"))


@query(
    """WITH p AS (SELECT p_partkey, (ARRAY['dichotomous', 'allocated_code', 'adjusted_code', 'categorical'])[p_partkey % 4 + 1] AS kind, p_size % 9 AS v, (ARRAY['', 'code', ' ', NULL, '1x'])[p_partkey // 4 % 12 + 1] AS odd, p_partkey // 4 % 12 < 5 AS is_odd FROM part)
    SELECT p_partkey, CASE WHEN is_odd THEN CASE kind WHEN 'allocated_code' THEN 'pending' ELSE 'forbidden' END WHEN v IN (1, 3, 5) THEN 'in_sample' WHEN kind = 'allocated_code' AND (v IN (2, 4, 6) OR v BETWEEN 1 AND 5) THEN 'pending' ELSE 'forbidden' END AS membership FROM p"""
)
def qualitative_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all parts; some are empty, null or no numbers."""
    text = lambda *v: F.array(*[F.lit(str(x)) for x in v])
    kind = F.element_at(F.array(*[F.lit(k) for k in rules.QUALITATIVE]), (F.col("p_partkey") % 4 + 1).cast("int"))
    at = F.floor(F.col("p_partkey") / 4) % 12
    odd = F.try_element_at(F.array(*[F.lit(x).cast("string") for x in ("", "code", " ", None, "1x")]), (at + 1).cast("int"))
    code = F.when(at < 5, odd).otherwise((F.col("p_size") % 9).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", rules.qualitative_membership(kind, code, text(1, 3, 5), text(1, 2, 3, 4, 5, 6)).alias("membership"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'refused' END WHEN 1 THEN CASE WHEN o_custkey % 2 = 1 THEN 'ok' ELSE 'refused' END ELSE 'unsupported' END AS status FROM orders")
def value_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.element_at(F.array(F.lit("market"), F.lit("reconstruction"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    method = F.when(F.col("o_custkey") % 2 == 0, "comparison").otherwise("cost")
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.value_basis(basis, method, {"market": ("comparison",), "reconstruction": ("cost",)}).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 10 END AS n, CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 3 END AS k, CASE WHEN p_partkey % 3 > 0 THEN 'fit' ELSE 'declared' END AS source, p_partkey % 3 > 0 AS conflict FROM part")
def effective_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("p_partkey") % 3 > 0
    got = rules.effective_size(F.lit(10), F.lit(3), F.when(known, F.col("p_size")), F.when(known, F.lit(2)))
    return read(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", "x.n", "x.k", "x.source", "x.conflict")


@query(f"WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS ({_LOG_SEARCH}) SELECT count(*) AS n_candidates, count(*) AS n_scored, round(avg(rmse), 5) AS mean, round(stddev_samp(rmse), 5) AS sd, round(min(rmse), 5) AS min, round(max(rmse), 5) AS max FROM c WHERE candidate_id LIKE '%identity%'")
def candidate_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.candidate_dispersion(_search(spark, sf_dir).records)
    return out.select("n_candidates", "n_scored", *[r(c, 5).alias(c) for c in ("mean", "sd", "min", "max")])


@query("WITH c AS (SELECT 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS candidate_id, p_retailprice AS rmse, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS p FROM part) SELECT candidate_id FROM c WHERE p IN (SELECT floor(i * (SELECT count(*) FROM part) / 50)::BIGINT FROM range(50) t(i))")
def sampled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("candidate_id"), F.col("p_retailprice").alias("rmse"), F.lit(1).alias("k"), F.lit("fitted").alias("status"))
    return search.sampled_history(search.rank(p), p.count(), 50).select("candidate_id")


@query("WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS (" + _LOG_SEARCH + "), k AS (SELECT candidate_id, row_number() OVER (ORDER BY rmse, candidate_id) AS k FROM c WHERE candidate_id LIKE '%identity%') SELECT candidate_id, row_number() OVER (ORDER BY k > 3, CASE WHEN k <= 3 THEN -k ELSE k END)::INT AS rank FROM k")
def shortlist_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three candidates by another score, which turns their order round; it comes after the objective, which is made equal here."""
    records_ = _search(spark, sf_dir).records
    flat = records_.withColumn("rmse", F.when(F.col("rank") <= 3, F.lit(0.0)).otherwise(F.col("rmse")))
    return search.rerank_shortlist(flat, lambda row: float(row["rank"]), 3).select("candidate_id", "rank")


@query("SELECT variable, round(r, 6) AS r FROM (SELECT 'l_quantity' AS variable, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem) ORDER BY abs(r) DESC LIMIT 2")
def most_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = regress.correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return search.most_correlated(c, "l_extendedprice", 2).select("variable", r("r").alias("r"))


@query("SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN log10(p_retailprice) WHEN 1 THEN 1 / p_retailprice WHEN 2 THEN ln(p_retailprice) ELSE p_retailprice * p_retailprice END, 9) AS x FROM part")
def recorded_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, by = F.col("p_retailprice"), F.col("p_partkey") % 4
    out = F.when(by == 0, transforms.recorded_transform("log10", x)).when(by == 1, transforms.recorded_transform("inv", x)).when(by == 2, transforms.recorded_transform("log", x)).otherwise(transforms.recorded_transform("square", x))
    return read(spark, sf_dir, "part").select("p_partkey", r(out, 9).alias("x"))


@query("SELECT count(*) AS n_effective, 3::BIGINT AS n_columns, (CASE WHEN count(DISTINCT l_quantity) > 1 THEN 2 ELSE 1 END)::BIGINT AS rank_slopes, (CASE WHEN count(DISTINCT l_quantity) > 1 THEN 3 ELSE 2 END)::BIGINT AS rank_with_intercept FROM lineitem")
def parameter_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("twice", 2 * F.col("l_quantity"))
    got = regress.parameter_ranks(li, ["l_quantity", "twice", "l_discount"])
    return spark.createDataFrame([tuple(got.values())], "n_effective bigint, n_columns bigint, rank_slopes bigint, rank_with_intercept bigint")


@query(
    """WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part), s AS (SELECT regr_r2(y, x) AS r2, count(*) AS n FROM p)
    SELECT 'r' AS measure, '' AS term, round(sqrt(r2), 6) AS value FROM s UNION ALL SELECT 'r2', '', round(r2, 6) FROM s UNION ALL SELECT 'f', '', round(r2 / ((1 - r2) / (n - 2)), 6) FROM s UNION ALL SELECT 'vif', 'x', 1.0 FROM s"""
)
def disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _simple(spark, sf_dir)
    rows = [(m, t, v) for m, t, v in regress.disclosure(f) if m in ("r", "r2", "f", "vif")]
    return spark.createDataFrame(rows, "measure string, term string, value double").withColumn("value", r("value"))


@query(
    """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'outside_support' END AS status, CASE WHEN p_partkey % 4 = 2 THEN 'nan'::DOUBLE ELSE p_retailprice END AS value FROM part WHERE p_partkey % 4 > 0)
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN p_partkey % 4 = 3 THEN value END AS value, CASE p_partkey % 4 WHEN 0 THEN 'no_prediction' WHEN 1 THEN p.status WHEN 2 THEN 'not_finite' END AS reason FROM part LEFT JOIN p ON id = p_partkey"""
)
def normalised_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of parts, each twice, of which some are missing, failed or not finite."""
    part = read(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    made = part.where(kind > 0).select("p_partkey", F.when(kind == 1, "outside_support").alias("status"), F.when(kind == 2, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("value"), F.lit(2).alias("turn"))
    first = made.withColumn("turn", F.lit(1)).withColumn("value", F.lit(0.0))
    return resample.normalise_predictions(part, made.unionByName(first), "p_partkey", "turn")


@query(
    """WITH t AS (SELECT 'o_comment' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_status', o_orderstatus FROM orders UNION ALL SELECT 'valor', CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) FROM orders UNION ALL SELECT 'o_contato', o_orderstatus FROM orders UNION ALL SELECT 'bairro', 'a ' || o_orderstatus FROM orders)
    SELECT c AS "column", avg((TRY_CAST(replace(replace(replace(v, 'R$', ''), '.', ''), ',', '.') AS DOUBLE) IS NOT NULL)::INT) AS numeric_share, round(avg(len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> ''))), 6) AS mean_words,
    CASE WHEN c = 'valor' THEN 'target' WHEN c = 'o_contato' OR c = 'o_comment' AND avg(len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> ''))) >= 2 THEN 'identifier' ELSE 'predictor' END AS role FROM t GROUP BY c"""
)
def suggested_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of text columns of the orders, some under names that say what they hold."""
    o = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    o = o.select(F.col("o_orderpriority").alias("o_comment"), status.alias("o_status"), F.col("o_totalprice").cast("decimal(20,0)").cast("string").alias("valor"), status.alias("o_contato"), F.concat(F.lit("a "), status).alias("bairro"))
    return profile.suggest_roles(o, o.columns).withColumn("mean_words", r("mean_words"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS locality, '2024-01-31' AS reference_date, CASE c_custkey % 3 WHEN 0 THEN 'offer' WHEN 1 THEN 'transaction' END AS observation_kind, 'interpreted' AS stage FROM customer"
)
def row_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locality, date and kind of every customer; every fifth locality is missing."""
    kind = F.element_at(F.array(F.lit("Oferta"), F.lit("sold"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise("n/a").alias("Bairro"), kind.alias("natureza"))
    return profile.identities(c, "c_custkey", "natureza", "2024-01-31")


@query("SELECT l_orderkey, l_linenumber, true AS bounded FROM lineitem")
def elasticity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is a straight line: the slope by differences is within twice the bound of the line's."""
    li = read(spark, sf_dir, "lineitem")
    made = value(li.where("l_orderkey % 2 = 0 AND l_quantity <= 30"), Request("l_extendedprice", ["l_quantity"]))
    (error,), (elasticity,) = score.elasticity_errors(li, made.frozen).values(), score.elasticities(li, made.frozen).values()
    fit = made.frozen.fit
    off = F.abs(elasticity * regress.prediction(fit) / F.col("l_quantity") - float(fit.beta[fit.columns.index("l_quantity")]))
    return li.select("l_orderkey", "l_linenumber", (off <= 2 * error).alias("bounded"))


@query()
def bootstrap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole selection on each of eight replicates, from one pass."""
    p = read(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return resample.bootstrap_selection(p, "id", "l_extendedprice", search.units_of(p, ["l_quantity", "l_discount"]), 8, 17)


@query("SELECT n_name, n_regionkey::VARCHAR AS n_regionkey, CASE WHEN n_regionkey = 2 THEN '''=' || n_name ELSE n_name END AS cell FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as safe CSV and read again, all cells as text."""
    n = read(spark, sf_dir, "nation").select("n_name", "n_regionkey", F.when(F.col("n_regionkey") == 2, F.concat(F.lit("="), "n_name")).otherwise(F.col("n_name")).alias("cell"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tabular.write_csv(n, path)
    return tabular.read_csv(spark, path)[0]


@query("SELECT r_regionkey::INT AS region, CASE r_regionkey WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' ELSE 'ok' END AS status FROM region UNION ALL SELECT (max(r_regionkey) + 1)::INT, 'unexpected' FROM region")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the nations, one a region, against the manifest of an earlier write: one region's file was changed since, one is gone, and one is new."""
    n, more = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").agg((F.max("r_regionkey") + 1).alias("r"))

    def files(rows: DataFrame) -> DataFrame:
        path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
        rows.withColumn("region", F.col("n_regionkey")).repartition(5, "region").sortWithinPartitions("n_nationkey").write.partitionBy("region").csv(path, header=True)
        return tabular.content_hashes(spark, path).where("path LIKE '%.csv'").select(F.regexp_extract("path", r"region=(\d+)/", 1).alias("path"), "bytes", "sha256")

    manifest = files(n)
    new = n.join(more, F.lit(True)).where("n_regionkey = 2").withColumn("n_regionkey", F.col("r").cast(n.schema["n_regionkey"].dataType)).drop("r")  # one row more
    now = n.where("n_regionkey <> 1").withColumn("n_name", F.when(F.col("n_regionkey") == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return tabular.verify_manifest(files(now.unionByName(new)), manifest).select(F.col("path").cast("int").alias("region"), "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of line prices, and every line as a subject with its intervals, extrapolation grade and status."""
    return batch_intervals(spark, sf_dir)

