import io
import zipfile

import pytest
from pyspark.sql import functions as F

from hedra.operators.encode import Encoder
from hedra.operators.regress import fit_ols
from hedra.operators.score import Frozen
from hedra.sources import tabular
from hedra.streaming.scoring import score_stream


def test_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿Área;Preço;Área\n50;\"R$ 1.234,56\";x\n60;;NA\n".encode())
    df, form, names = tabular.read_csv(spark, str(path))
    assert form.delimiter == ";" and form.bom and df.columns[:2] == ["área", "preço"]
    assert [tuple(r)[:2] for r in df.collect()] == [("50", "R$ 1.234,56"), ("60", "")]
    latin = tmp_path / "l.csv"
    latin.write_bytes("preço,área\n1,2\n".encode("cp1252"))
    assert tabular.read_csv(spark, str(latin))[0].columns == ["preço", "área"]
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(tabular.IngestError, match="empty_file"):
        tabular.read_csv(spark, str(tmp_path / "e.csv"))
    with pytest.raises(tabular.IngestError, match="unsupported_format"):
        tabular.read_csv(spark, "x.pdf")
    assert tabular.read_csv(spark, str(path), most_bytes=1000)[0].count() == 2
    with pytest.raises(tabular.IngestError, match="file_too_large"):
        tabular.read_csv(spark, str(path), most_bytes=10)


def test_form_is_read_from_the_head_alone(spark, tmp_path):
    """No task or row holds a file: the first one is far longer than Spark may take as one value."""
    for name, cell in (("a", "9"), ("b", "x")):
        (tmp_path / f"{name}.csv").write_bytes(b"n;text\n" + f"{cell};y\n".encode() * 50_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        df, form, _ = tabular.read_csv(spark, str(tmp_path))
        assert form.columns == ("n", "text") and form.delimiter == ";" and df.count() == 100_000
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_xlsx(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>50</v></c><c r="B2"><v>1.5</v></c></row><row><c r="B3"><v>2</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Area</t></si><si><t>Price</t></si></sst>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    (tmp_path / "m.xlsx").write_bytes(data.getvalue())
    df, names = tabular.read_xlsx(spark, str(tmp_path / "m.xlsx"))
    assert names == {"Area": "area", "Price": "price"} and [tuple(r) for r in df.collect()] == [("50", "1.5"), ("", "2")]


def test_manifest_and_cells(spark, tmp_path):
    df = spark.createDataFrame([("=1", 0.1), ("x", 1 / 3)], "t string, v double")
    made = tabular.write_pair(df, str(tmp_path / "out")).where("path LIKE '%.csv'")
    due = spark.createDataFrame([*((r["path"], r["sha256"]) for r in made.collect()), ("gone", "0")], "path string, sha256 string")
    assert {r["status"] for r in tabular.verify_manifest(made, due).collect()} == {"ok", "missing"}
    safe = spark.read.csv(str(tmp_path / "out/safe"), header=True).collect()
    assert {r["t"] for r in safe} == {"'=1", "x"} and {float(r["v"]) for r in safe} == {0.1, 1 / 3}
    back = tabular.hex_number("v", df).collect()
    assert all(float.fromhex(r["v_hex"]) == r["v"] == float(r["v_text"]) for r in back)


def test_stream(spark, tmp_path):
    train = spark.range(50).select((F.col("id") + 10.0).alias("area"), (F.col("id") * 3.0 + F.col("id") % 3).alias("price"))
    frozen = Frozen(Encoder(numeric={"area": None}), fit_ols(train, "price", ["area"]), "price", {"area": (10.0, 59.0)})
    spark.createDataFrame([("a", 20.0), ("b", 900.0)], "subject_id string, area double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject_id string, area double").parquet(str(tmp_path / "in"))
    score_stream(stream, frozen, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert {(r["subject_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "succeeded"), ("b", "out_of_domain")}
