"""End-to-end runs (PL-1..6) composed from the operators.

* ``full_preparation`` (PL-1): schema-kind dispatch -> call path (drop, dates,
  median / mode fill, FE-A, AGG-2) or profile path (AGG-1, drop, median fill,
  FE-C, zero fill) -> label.
* ``train_complete`` (PL-2): stratified split -> boosted trees -> evaluation and cross-validation -> saved model.
* ``complete_scoring`` (PL-3): safety score -> band -> reasons, by true id.
* ``complete_run`` (PL-4): PL-1 -> PL-2 -> PL-3 -> exports -> summary; returns
  the manifest.
* ``optimization_run`` (PL-5): FE-B call grain -> forest baseline -> median
  importance selection -> oversampling (or class weights) on training rows ->
  grid search -> comparison -> report row.
* ``start_live_scoring`` (PL-6): live event stream -> CRM join -> session state
  machine -> per-agent sink; ``start_crm_updates``: -> written CRM upsert.

Unlike the original, a failure never falls back to synthetic data.
"""

from __future__ import annotations

import os
from statistics import mean, pstdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ranking import auc_from_scores
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import explain as X
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import oversample as OS
from ..operators import rules as R
from ..session import stored
from ..sinks import writers as W
from ..sinks.versions import KeyedTable, upsert_stream
from ..streaming import sessions as ST


def full_preparation(df: DataFrame, order_by=("start_ts", "contact_id")) -> DataFrame:
    """PL-1: one row per customer with a 0/1 ``label``."""
    if C.is_call_centre(df):
        cust = (df.transform(C.clean_call_records).transform(FE.call_features_plus_one)
                .transform(A.customer_rollup))
    else:
        cust = (A.customer_means(df, list(order_by)).transform(C.drop_configured).transform(C.median_fill)
                .transform(FE.profile_features).transform(C.zero_fill))
    return C.encode_label_a(cust)


def evaluation(scored: DataFrame) -> dict:
    """Accuracy beside the majority rate, exact AUC, confusion cells and the classification report of
    predictions: a fixed number of values."""
    out = {k: v for k, v in MD.evaluate(scored).items()}
    for r in M.confusion(scored).collect():                         # four cells
        out[f"confusion_{r['label']}_{r['pred']}"] = r["n"]
    for r in M.classification_report(scored).collect():             # one row per class and average
        for c in ("precision", "recall", "f1"):
            if r[c] is not None:
                out[f"{str(r['class']).replace(' ', '_')}_{c}"] = r[c]
    return out


def train_complete(customers: DataFrame, model_dir: str | None = None, version: str = "v1",
                   params: dict | None = None, folds: int = 5, tune: bool = False, grid: dict | None = None,
                   tune_folds: int = 3):
    """PL-2: stratified split, fit (with ``tune`` the training grid is searched first, in three folds), evaluation on the
    test split, cross-validated AUC on the training split, and optionally save.  Returns (model,
    features, frame, metrics dict)."""
    feats = MD.feature_names(customers)
    frame = MD.with_split(MD.assemble(customers, feats))
    train = frame.filter(~F.col("is_test"))
    if tune:
        model, params = MD.tuned(train, MD.boosted(params), grid or MD.TRAINING_GRID, tune_folds)
    else:
        model = MD.fit_persisted(MD.boosted(params), train)
    scored = M.predict_at(MD.p_default(model.transform(frame.filter(F.col("is_test")))), "p_default")
    metrics = evaluation(scored)
    aucs = [a for a in MD.cross_validated_auc(train, MD.boosted(params), folds) if a is not None]
    metrics["cv_auc_mean"] = mean(aucs) if aucs else None
    metrics["cv_auc_std"] = pstdev(aucs) if aucs else None
    if model_dir:
        W.save_model(model, model_dir, "boosted", version, {"features": feats, "params": params or {},
                                                            "metrics": metrics})
    return model, feats, frame, metrics


def complete_scoring(model, frame: DataFrame, feats: list[str], top_n: int = 3) -> DataFrame:
    """PL-3: id, safety score, batch band, reasons (global importance fallback)."""
    imp = sorted(MD.importances(model, feats), key=lambda t: (-t[1], t[0]))
    scored = MD.p_default(model.transform(frame))
    safety = R.safety_score("p_default")
    return scored.select(F.col(S.ID_COL).alias("customer_id"), safety.alias("risk_score"),
                         R.safety_band(safety).alias("risk_category"),
                         X.importance_reasons([f for f, _ in imp[:top_n]]).alias("top_risk_factors"))


def complete_run(spark: SparkSession, calls: DataFrame, out_dir: str, run_id: str,
                 params: dict | None = None) -> DataFrame:
    """PL-4: prepare -> train -> score the test customers -> export everything."""
    cust = full_preparation(calls)
    model, feats, frame, metrics = train_complete(cust, os.path.join(out_dir, "models"), run_id, params)
    results = complete_scoring(model, frame.filter(F.col("is_test")), feats)
    mrows = spark.createDataFrame([(k, float(v)) for k, v in metrics.items() if v is not None],
                                  "metric string, value double")
    imp = spark.createDataFrame(MD.importances(model, feats), "feature string, importance double")
    summary = results.agg(F.lit(metrics["accuracy"]).alias("accuracy"), F.lit(metrics["auc"]).alias("roc_auc"),
                          *[F.lit(metrics.get(f"weighted_avg_{m}")).cast("double").alias(m)
                            for m in ("precision", "recall", "f1")],
                          F.lit(len(feats)).alias("n_features"), F.lit(cust.count()).alias("n_customers"),
                          F.count(F.lit(1)).alias("customers_scored"),
                          F.avg("risk_score").alias("mean_score"),
                          F.count_if(F.col("risk_category") == S.BATCH_LABELS[2]).alias("high_risk_customers"))
    return W.export_run(spark, out_dir, run_id, results, mrows, imp, summary)


def oversampling(calls: DataFrame, feats: list[str], key: str = "contact_id"):
    """A ``prepare`` step for searches and fits: the given training rows with the synthetic rows that bring
    their classes to parity, assembled.  ``calls`` holds the feature columns of all rows."""
    def prepare(rows: DataFrame) -> DataFrame:
        whole = calls.select(key, "label", *feats).join(rows.select(key), key, "left_semi")
        both = stored(OS.oversampled(whole, feats, key), "oversampled")
        return MD.assemble(both.withColumn("row_no", F.monotonically_increasing_id()), feats, key="row_no")

    return prepare


def optimization_run(spark: SparkSession, calls: DataFrame, grid: dict | None = None, params: dict | None = None,
                     folds: int = 5, model_dir: str | None = None, version: str = "optimized",
                     rebalance: str = "oversample") -> DataFrame:
    """PL-5 at call grain: stratified split first, the training rows of each fit oversampled (``rebalance`` =
    "oversample") or weighted ("weights"), the full grid unless another one is given; the optimised model is
    saved where ``model_dir`` is given."""
    if rebalance not in ("oversample", "weights"):
        raise ValueError(f"unknown rebalancing {rebalance!r}")
    c = calls.transform(FE.call_features_nonzero)
    c = stored(C.encode_label_b(C.mean_fill(C.coerce_numeric(c, MD.feature_names(
        c, "contact_id", "label", (S.ID_COL, S.TARGET_COL))))), "optimization-calls")
    feats = MD.feature_names(c, "contact_id", "label", (S.ID_COL, S.TARGET_COL))
    frame = MD.with_split(MD.assemble(c, feats, key="contact_id"), "contact_id")
    te = frame.filter(F.col("is_test"))
    base = MD.fit_persisted(MD.forest(100), frame.filter(~F.col("is_test")))
    base_auc = auc_from_scores(MD.p_default(base.transform(te)), "label", "p_default").first()["auc"]
    keep = MD.select_by_median_importance(MD.importances(base, feats))
    sel = MD.with_split(MD.assemble(c, keep, key="contact_id"), "contact_id")
    tr2, te2 = sel.filter(~F.col("is_test")), sel.filter(F.col("is_test"))
    prepare = oversampling(c, keep) if rebalance == "oversample" else MD.class_weights
    estimator = MD.boosted(params, **({"weightCol": "weight"} if rebalance == "weights" else {}))
    model, best = MD.tuned(tr2, estimator, grid or MD.FULL_GRID, folds, key="contact_id", prepare=prepare)
    scored = M.predict_at(MD.p_default(model.transform(te2)), "p_default")
    measured = evaluation(scored)
    comparison = MD.compare_models(tr2, te2, {"random_forest": MD.forest(100), "boosted_trees": MD.boosted(params)})
    importance = MD.importances(model, keep)
    if model_dir:
        W.save_model(model, model_dir, "optimized", version, {"features": keep, "params": best, "metrics": measured})
    return W.report_row(spark, {"baseline_auc": base_auc, "optimized_auc": measured["auc"],
                                "improvement": (measured["auc"] or 0) - (base_auc or 0),
                                "selected_features": keep, "best_params": best, "evaluation": measured,
                                "importances": dict(importance), "comparison": dict(comparison)})


def start_live_scoring(events_stream: DataFrame, crm: DataFrame, out_dir: str, checkpoint: str,
                       trigger: dict | None = None):
    """PL-6: live events -> state machine -> call-start, score, call-end, summary and rejection messages,
    delivered per agent."""
    messages = ST.live_results(ST.score_events(events_stream, crm), crm)
    return W.deliver_rooms(messages, out_dir, checkpoint, "agent_id", trigger)


#: A call whose end never comes keeps writing its scores for so long after its last event.
CRM_OPEN_MS = 30 * 24 * 3_600_000


def start_crm_updates(events_stream: DataFrame, crm: DataFrame, table: KeyedTable, checkpoint: str,
                      trigger: dict | None = None, timeout_ms: int = CRM_OPEN_MS):
    """PL-6 / SNK-8: every live score goes back to the customer's record: score, level, time, factors and
    recommendations, the latest one staying.  The update key is the customer, who calls under the same id.
    A call takes scores until its end event, as in the original."""
    scored = ST.live_results(ST.score_events(events_stream, crm), crm, timeout_ms=timeout_ms).where("outcome = 'SCORED'")
    updates = W.risk_update_record(scored.select(
        F.col("call_id").alias("customer_id"), "risk_score", F.col("risk_category").alias("risk_level"),
        F.col("ts").alias("risk_updated_at"), "event_id", "factors", "recommendations"))
    return upsert_stream(updates, table, checkpoint, trigger=trigger)
