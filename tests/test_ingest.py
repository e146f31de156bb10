import pytest
from pyspark.sql import functions as F

from hedra.operators.ordered import number_by_hash, number_rows
from hedra.operators.score import Frozen, score_batch
from hedra.plans.ingest import Source, ingest, ingest_csv, resolve_candidates, resolve_roles, resolve_target
from hedra.plans.valuation import Request, value

NAMES = {"Preço": "preço", "Área (m²)": "área_m²", "Cod": "cod"}


def test_names_and_roles():
    assert resolve_roles({"Preço": "target", "cod": "identifier", "x": "source", "Área (m²)": "odd"}, NAMES) == ({"preço": "target", "cod": "identifier"}, [("role_column_absent", "x"), ("role_invalid", "Área (m²)")])
    assert resolve_target(None, {"a": "target"}, NAMES) == ("a", [])
    assert resolve_target(None, {"a": "target", "b": "target"}, NAMES)[1][0][0] == "target_role_ambiguous"
    assert resolve_target(None, {}, NAMES) == (None, [("target_not_declared", "")])
    assert resolve_target("nope", {}, NAMES) == (None, [("target_not_found", "nope")])
    assert resolve_target("Preço", {"cod": "target"}, NAMES) == ("preço", [("target_role_conflict", "preço")])
    assert resolve_candidates(None, {"cod": "identifier"}, "preço", NAMES) == (["área_m²"], [("candidate_selection_auto", "")])
    assert resolve_candidates([], {}, "preço", NAMES) == ([], [("empty_candidate_selection", "")])
    assert resolve_candidates(["Cod", "row_id", "preço", "z"], {}, "preço", NAMES) == (["cod"], [("candidate_is_row_id", "row_id"), ("candidate_is_target", "preço"), ("requested_column_absent", "z")])


def test_cells_keep_their_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Cod;Preço;Área (m²);Bairro\n01;1.234,56;50;Sé\n02;;1.000;NA\n03;1.2.3;60,5;\n04;inf;x;Sé\n05;a combinar;70;Sé\n06;R$ 99;80;Sé\n", encoding="utf-8")
    auto = ingest_csv(spark, str(tmp_path / "m.csv"), Source("Preço", {"Bairro": "predictor"}))
    got = {r["cod"]: r for r in auto.rows.collect()}
    assert auto.converted == {"cod": False, "preço": True, "área_m²": True, "bairro": False} and auto.numeric == ["área_m²"] and auto.categorical == ["cod", "bairro"]
    assert got["02"]["área_m²"] is None and got["02"]["original"]["área_m²"] == "1.000" and got["02"]["reasons"] == ["ambiguous_number", "missing_target"] and got["02"]["missing_before"] == ["preço", "bairro"]
    assert {c: got[c]["disposition"] for c in got} == {"01": "observed", "02": "pending_target", "03": "rejected", "04": "rejected", "05": "pending_target", "06": "observed"}
    assert got["01"]["target_value"] == 1234.56 and got["04"]["reasons"] == ["non_finite_value", "non_finite_target"] and got["05"]["reasons"] == ["unusable_target"]
    assert len({r["row_id"] for r in got.values()}) == 6 and all(r["row_id"].startswith("R00000") for r in got.values())
    local = ingest_csv(spark, str(tmp_path / "m.csv"), Source("Preço", locale="pt-BR"))
    assert {r["raw"]: r["value"] for r in local.changes().where("`column` = 'área_m²'").collect()} == {"50": 50.0, "1.000": 1000.0, "60,5": 60.5, "70": 70.0, "80": 80.0}
    assert {(r["raw"], r["code"]) for r in local.cell_issues().collect()} == {("1.2.3", "malformed_number"), ("inf", "non_finite_value")}
    assert local.summary().first().asDict() == {"n_received": 6, "n_observed": 2, "n_pending": 2, "n_rejected": 2}


def test_empty_table(spark):
    none = spark.createDataFrame([], "a string, b string")
    found = ingest(none, {"A": "a", "B": "b"}, Source("A"))
    assert found.rows.count() == 0 and found.converted["a"]


def test_level_and_locale_reach_the_values(spark):
    rows = [(f"{10 + i},5", f"{3 * i + i % 3},25") for i in range(40)]
    texts = spark.createDataFrame(rows, "area string, price string")
    numbers = texts.select(F.replace("area", F.lit(","), F.lit(".")).cast("double").alias("area"), F.replace("price", F.lit(","), F.lit(".")).cast("double").alias("price"))
    ask = lambda **more: Request("price", ["area"], locale="pt-BR", **more)
    made, plain = value(texts, ask()), value(numbers, ask())
    assert list(made.frozen.fit.beta) == pytest.approx(list(plain.frozen.fit.beta))
    subjects = spark.createDataFrame([("a", "20,5"), ("b", "1.000"), ("c", "odd"), ("d", None)], "subject_id string, area string")
    got = {r["subject_id"]: r for r in made.score(subjects).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "succeeded", "b": "out_of_domain", "c": "unsupported", "d": "unsupported"}
    wide = value(texts, ask(level=0.95))
    far = {r["subject_id"]: r for r in wide.score(subjects).collect()}["a"]
    assert far["mean_high"] - far["mean_low"] > 1.4 * (got["a"]["mean_high"] - got["a"]["mean_low"])
    again = Frozen.loads(wide.frozen.dumps())
    assert (again.level, again.locale) == (0.95, "pt-BR") and wide.frozen.reuse_key() != made.frozen.reuse_key()
    assert {r["subject_id"]: r["mean_low"] for r in score_batch(subjects, again).collect()}["a"] == far["mean_low"]
    # a declared domain reads texts too
    again.domain = {"area": (15.0, 30.0)}
    assert {r["subject_id"]: r["outside_domain"] for r in score_batch(subjects, again).collect()} == {"a": [], "b": ["area"], "c": ["area"], "d": ["area"]}


def test_repeated_ids_are_refused(spark):
    df = spark.range(30).select(F.least("id", F.lit(28)).alias("id"), (F.col("id") + 1.0).alias("x"), (F.col("id") * 2.0 + F.col("id") % 3).alias("y"))
    with pytest.raises(ValueError, match="duplicate_row_id"):
        value(df, Request("y", ["x"], row_id="id"))
    with pytest.raises(ValueError, match="row_id_absent"):
        value(df, Request("y", ["x"], row_id="nope"))
    assert value(df.where("id < 28"), Request("y", ["x"], row_id="id")).frozen.fit.n == 28


def test_the_source_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spark.range(40).select((F.col("id") % 30).cast("string").alias("a"), F.concat(F.lit("R$ 1."), F.col("id") + 100, F.lit(",5")).alias("b"), F.when(F.col("id") % 3 > 0, "NA").alias("c"))
    found = ingest(made.mapInArrow(count, made.schema), {"A": "a", "B": "b", "C": "c"}, Source("B", locale="pt-BR"))
    got = found.rows.collect()
    assert seen.value == 40 and sorted(r["row_id"] for r in got) == [f"R{i:06}" for i in range(40)]
    assert all(r["target_value"] == float(r["original"]["b"][3:].replace(".", "").replace(",", ".")) for r in got)
    assert all(r["missing_before"] == ["c"] and r["c"] is None for r in got)


def test_numbers_by_hash_are_those_in_its_order(spark):
    df = spark.range(3000).select((F.col("id") % 2500).cast("string").alias("x")).withColumn("h", F.xxhash64("x"))
    got, n = number_by_hash(df, "h", "x")
    want = number_rows(df, "h", "x").groupBy("x").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert n == 3000 and sorted(map(str, got.groupBy("x").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect())) == sorted(map(str, want.collect()))
    assert number_by_hash(df.limit(0), "h", "x")[1] == 0
