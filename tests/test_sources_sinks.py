"""Sources and sinks: workbook reader, CSV, exports, model save / load, per-agent push."""

import io
import os
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrisk import schema as S
from callrisk.sinks import writers as W
from callrisk.sources import files as FS


def _xlsx(rows):
    """A minimal workbook (shared strings for text, numbers inline) built by hand."""
    strings, cells_xml = [], []
    for ri, row in enumerate(rows, start=1):
        cells = []
        for ci, v in enumerate(row):
            ref = f"{chr(65 + ci)}{ri}"
            if v is None:
                continue
            if isinstance(v, str):
                strings.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells_xml.append(f'<row r="{ri}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="s" sheetId="1" r:id="rId1"/>'
                                      f'</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="ws"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells_xml)}</sheetData></worksheet>')
    return buf.getvalue()


def test_workbook_reader(spark, scratch):
    d = os.path.join(scratch, "raw")
    os.makedirs(d)
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_xlsx([["レコード番号", "未払FLAG", "agent_talktime", "agent_talktime通話時間"],
                       [1, "未払", 12.5, "00:01:02"], [2, "支払済", None, "n/a"], [3, "未払", 7, None]]))
    with open(os.path.join(d, "b.xlsx"), "wb") as f:
        f.write(_xlsx([["レコード番号", "未払FLAG"], [4, "支払済"]]))
    schema = T.StructType([T.StructField("record_no", T.LongType()), T.StructField("unpaid_flag", T.StringType()),
                           T.StructField("agent_talktime", T.DoubleType()),
                           T.StructField("agent_talktime_text", T.StringType())])
    inv = {v: k for k, v in S.ORIGINAL_NAMES.items()}
    df = FS.read_workbooks(spark, os.path.join(d, "*.xlsx"), schema, inv).orderBy("record_no").collect()
    assert [(r["record_no"], r["unpaid_flag"], r["agent_talktime"]) for r in df] == \
        [(1, "未払", 12.5), (2, "支払済", None), (3, "未払", 7.0), (4, "支払済", None)]
    assert df[0]["agent_talktime_text"] == "00:01:02"


def test_csv_roundtrip_and_exports(spark, scratch):
    df = spark.createDataFrame([(1, 80.0, "Low Risk"), (2, 20.0, "High Risk")],
                               "customer_id long, risk_score double, risk_category string")
    p = W.write_table(df, os.path.join(scratch, "t.csv"), "csv")
    back = FS.read_csv(spark, p, "customer_id long, risk_score double, risk_category string")
    assert back.exceptAll(df).count() == 0
    metrics = spark.createDataFrame([("accuracy", 0.8), ("roc_auc", 0.6)], "metric string, value double")
    imp = spark.createDataFrame([("a", 0.5)], "feature string, importance double")
    summ = W.report_row(spark, {"customers_scored": 2, "best": {"depth": 6}})
    man = W.export_run(spark, os.path.join(scratch, "run"), "r1", df, metrics, imp, summ).collect()
    assert {r["artefact"] for r in man} == {"risk_scores", "metrics_json", "metrics_csv", "feature_importance", "summary"}
    again = spark.read.parquet(os.path.join(scratch, "run", "risk_scores"))
    assert again.filter(F.col("run_id") == "r1").count() == 2
    wide = spark.read.option("header", True).csv(os.path.join(scratch, "run", "metrics", "metrics_r1.csv")).first()
    assert float(wide["accuracy"]) == 0.8


def test_model_save_load_same_predictions(spark, scratch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(0, 200).select((F.col("id") % 10).cast("double").alias("x"),
                                    (F.col("id") % 10 > 5).cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LogisticRegression()]).fit(df)
    W.save_model(model, os.path.join(scratch, "models"), "risk", "v1", {"features": ["x"]})
    W.save_model(model, os.path.join(scratch, "models"), "risk", "v2", {"features": ["x"]})
    loaded, meta = W.load_model(os.path.join(scratch, "models"), "risk")
    assert meta["version"] == "v2" and meta["features"] == ["x"]
    a = model.transform(df).select("prediction").collect()
    b = loaded.transform(df).select("prediction").collect()
    assert a == b


def test_push_by_agent(spark, scratch):
    src = os.path.join(scratch, "results")
    spark.createDataFrame([("c1", "a1", 50.0), ("c2", "a2", 70.0), ("c3", "a1", 40.0)],
                          "call_id string, agent_id string, risk_score double").write.parquet(src)
    stream = spark.readStream.schema("call_id string, agent_id string, risk_score double").parquet(src)
    q = W.push_by_agent(stream, os.path.join(scratch, "rooms"), os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    rooms = sorted(p for p in os.listdir(os.path.join(scratch, "rooms")) if p.startswith("agent_id="))
    assert rooms == ["agent_id=a1", "agent_id=a2"]
    assert spark.read.parquet(os.path.join(scratch, "rooms", "agent_id=a1")).count() == 2


def test_rerun_export_is_idempotent(spark, scratch):
    df = spark.createDataFrame([(1, 80.0), (2, 20.0)], "customer_id long, risk_score double")
    base = os.path.join(scratch, "scores")
    W.export_risk_scores(df, base, "r1")
    W.export_risk_scores(df, base, "r2")
    W.export_risk_scores(df, base, "r1")                   # rerun of r1 after a failure
    out = spark.read.parquet(base)
    assert out.filter(F.col("run_id") == "r1").count() == 2 and out.count() == 4


def test_original_headers_and_key_quarantine(spark, scratch):
    from callrisk.operators import clean as C
    df = spark.createDataFrame([(1, "未払", 3.0), (None, "支払済", 4.0)],
                               "record_no long, unpaid_flag string, days_call_to_contract double")
    ok, bad = C.split_null_keys(df)
    assert ok.count() == 1 and bad.first()["reason"] == "missing: record_no"
    out = W.to_original_names(ok)
    assert out.columns == ["レコード番号", "未払FLAG", "電話日-成約日"]
    p = W.write_table(out, os.path.join(scratch, "orig.csv"), "csv")
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["レコード番号", "未払FLAG", "電話日-成約日"]


def test_workbook_date_serials_and_csv_original_headers(spark, scratch):
    d = os.path.join(scratch, "wb")
    os.makedirs(d)
    with open(os.path.join(d, "c.xlsx"), "wb") as f:          # 45292.5 = 2024-01-01 12:00
        f.write(_xlsx([["レコード番号", "開始タイムスタンプjst"], [1, 45292.5], [2, "2024-01-02 08:30:00"]]))
    schema = T.StructType([T.StructField("record_no", T.LongType()), T.StructField("start_ts", T.TimestampType())])
    inv = {v: k for k, v in S.ORIGINAL_NAMES.items()}
    got = {r["record_no"]: str(r["start_ts"]) for r in FS.read_workbooks(spark, d, schema, inv).collect()}
    assert got == {1: "2024-01-01 12:00:00", 2: "2024-01-02 08:30:00"}
    p = os.path.join(scratch, "orig.csv")
    W.write_table(W.to_original_names(spark.createDataFrame([(5, "未払")], "record_no long, unpaid_flag string")),
                  p, "csv")
    back = FS.read_csv(spark, p, "record_no long, unpaid_flag string, agent string", inv).first()
    assert (back["record_no"], back["unpaid_flag"], back["agent"]) == (5, "未払", None)


def test_tuning_takes_its_grid_and_fails_loudly(spark):
    import pytest
    from callrisk.operators import models as MD
    points = [1, 1]
    for k, grid in enumerate((MD.TRAINING_GRID, MD.FULL_GRID)):
        for values in grid.values():
            points[k] *= len(values)
    assert points == [81, 216]
    df = spark.range(0, 60).select(F.col("id").alias("record_no"), (F.col("id") % 5).cast("double").alias("x"),
                                   (F.col("id") % 2).cast("int").alias("label"))
    frame = MD.with_split(MD.assemble(df, ["x"]))
    assert frame.filter("is_test").groupBy("label").count().select("count").distinct().collect()[0][0] == 6
    model, best = MD.tuned(frame, MD.boosted(maxIter=2), {"maxDepth": [1, 2]}, folds=2)
    assert best["maxDepth"] in (1, 2) and model is not None
    with pytest.raises(Exception):
        MD.tuned(frame, MD.boosted(maxIter=2), {"maxDepth": [-1]}, folds=2)


def test_models_beat_the_majority_on_a_signal(spark):
    from callrisk.operators import models as MD
    x = ((F.col("id") * 7919) % 1000 / 1000.0)
    df = spark.range(0, 2000).select(F.col("id").alias("record_no"), x.alias("x"), ((F.col("id") * 31) % 97).cast("double").alias("noise"),
                                     (x + ((F.col("id") * 104729) % 100 - 50) / 200.0 > 0.7).cast("int").alias("label"))
    frame = MD.with_split(MD.assemble(df, ["x", "noise"]))
    for est in (MD.boosted(maxIter=10, maxDepth=3), MD.forest(20)):
        model = MD.fit_persisted(est, frame.filter("not is_test"))
        got = MD.evaluate(MD.p_default(model.transform(frame.filter("is_test"))))
        assert got["auc"] > 0.7 and got["accuracy"] >= got["majority_rate"]
        assert MD.select_by_median_importance(MD.importances(model, ["x", "noise"])) == ["x"]
    out, _ = MD.linear_attributions(frame, ["x", "noise"], train=frame.filter("not is_test"))
    gap = out.select(F.max(F.abs(F.col("base_value") + F.col("c_x") + F.col("c_noise") - F.col("logit")))).first()[0]
    assert gap < 1e-9


def test_workbook_skips_phonetic_text_and_counts_cells(spark, tmp_path):
    import io
    import zipfile
    from pyspark.sql import types as T
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><workbookPr date1904="1"/><sheets><sheet name="s" sheetId="1" '
                                      'r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                                                 'relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>未払FLAG</t><rPh sb="0" eb="2"><t>ミバラ</t></rPh></si>'
                                           '<si><r><t>顧</t></r><r><t>客</t></r><rPh sb="0" eb="1"><t>コ</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c>'
                                               '<c t="inlineStr"><is><t>day</t></is></c></row><row><c><v>1</v></c>'
                                               '<c t="inlineStr"><is><t>x</t></is></c><c><v>366</v></c></row></sheetData></worksheet>')
    (tmp_path / "book.xlsx").write_bytes(body.getvalue())
    schema = T.StructType([T.StructField("unpaid", T.LongType()), T.StructField("who", T.StringType()),
                           T.StructField("day", T.DateType())])
    row = FS.read_workbooks(spark, str(tmp_path / "book.xlsx"), schema, {"未払FLAG": "unpaid", "顧客": "who"}).first()
    assert (row["unpaid"], row["who"], str(row["day"])) == (1, "x", "1905-01-01")
