import json

import pytest

from tillstats import contract
from tillstats.errors import CorruptDataError, FileNotFoundOrEmptyError, SchemaValidationError
from tillstats.operators.quality import CleaningReport
from tillstats.operators.regression import Diagnostics
from tillstats.plans import pipeline, report
from tillstats.sources import checks, csv, sinks

HEADER = ";".join(contract.RAW_COLUMNS)


def line(k, channel="POS", product="Soap", units="2", discount="0.1", amount="1000.5", birth="1990-05-17"):
    return f"2026-01-{1 + k % 28:02d} 10:00:00;{channel};{1000 + k};{product};{units};{discount};{amount};{k // 2};{1001 + k % 3};C{k % 7};R;N;A;{birth};{1 + k % 2}"


def write(tmp_path, *lines):
    path = tmp_path / "sales.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundOrEmptyError):
        csv.load(spark, str(tmp_path / "nothing.csv"))
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(FileNotFoundOrEmptyError):
        csv.load(spark, str(tmp_path / "empty.csv"))


def test_corrupt_and_incomplete(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(bytes([0xFF, 0xFE, 0, 1, 2]) * 20)
    with pytest.raises(CorruptDataError):
        csv.load(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "short.csv").write_text("FECHA;CANAL\n2026-01-01;POS\n")
    with pytest.raises(SchemaValidationError):
        csv.load(spark, str(tmp_path / "short.csv"))
    with pytest.raises(CorruptDataError):
        csv.load(spark, write(tmp_path))


def test_line_policy(spark, tmp_path):
    path = write(tmp_path, line(0), line(1) + ";extra", "2026-01-02 10:00:00;WEB;5", line(3, product='"a;b"'), line(4, birth="1999-04-01 05:00:00", units="x"))
    df = csv.load(spark, path)
    rows = {r["SKU"]: r for r in df.collect()}
    assert set(rows) == {1000, 5, 1003, 1004} and df.columns == list(contract.COLUMNS)
    assert rows[5]["MONTO_APLICADO"] is None and rows[1003]["PRODUCTO"] == "a;b" and str(rows[1000]["FECHA_NACIMIENTO"]) == "1990-05-17"
    assert rows[1004]["FECHA_NACIMIENTO"] is None and rows[1004]["UNIDADES"] is None and rows[1004]["GENERO"] == 1
    assert csv.channel_levels(df) == ["POS", "WEB"]
    assert csv.read_sample(spark, path).skipped == 1


def test_checks(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("inf"), "b"), (None, "c")], "x double, s string")
    assert checks.infinite_counts(df, ["x", "gone"]) == {"x": 1}
    checks.require_numeric(df, "x")
    for bad in ("s", "gone"):
        with pytest.raises(SchemaValidationError):
            checks.require_numeric(df, bad)


def test_sinks(spark, tmp_path):
    target = sinks.save_table(spark.createDataFrame([(1, "ñ")], "a int, b string"), "t", str(tmp_path / "x"))
    assert open(target, encoding="utf-8").read() == "a,b\n1,ñ\n"
    assert json.load(open(sinks.save_json({"a": "ñ"}, "j", str(tmp_path)), encoding="utf-8")) == {"a": "ñ"}


def test_rules():
    good = {"r2_adjusted": 0.8}
    assert report.extrapolability(good, Diagnostics(0.5, 0.5, [("a", 1.2)], 0.8, 0.8), CleaningReport())["es_extrapolable"]
    bad = report.extrapolability({"r2_adjusted": 0.1}, Diagnostics(0.01, 0.01, [("a", 50.0)], 0.1, 0.1), CleaningReport(outliers={"x": 3}))
    assert not bad["es_extrapolable"] and len(bad["advertencias"]) == 5


def test_settings(monkeypatch):
    monkeypatch.setenv("TILLSTATS_SEED", "x")
    monkeypatch.setenv("TILLSTATS_JOBS", "0")
    assert contract.Settings().seed == 42 and contract.Settings().jobs >= 1


def test_whole_run(spark, tmp_path):
    lines = [line(k, "POS WEB APP".split()[k % 3], units=str(1 + k % 4), discount="" if k % 10 == 0 else f"0.{k % 3}1", amount=str(1000 + 137 * (k % 17)) if k else "999999") for k in range(200)]
    out = tmp_path / "out"
    assert pipeline.run(spark, write(tmp_path, *lines), str(out), study=False, n_init=1) == 0
    assert {"store_stats.csv", "describe.csv", "hypothesis_tests.csv", "daily_series.csv", "vif.csv", "validation_summary.csv"} <= {p.name for p in (out / "tables").iterdir()}
    assert json.loads((out / "reports/cleaning.json").read_text())["outliers"]["MONTO_APLICADO"] == 1
    assert pipeline.run(spark, str(tmp_path / "nothing"), str(out)) == 1
