"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (through the adapter views) and runs on
whole tables.  Double outputs are rounded to 6 digits so results compare
exactly with the DuckDB oracles in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import features as FE
from ..operators import rules as R
from .. import schema as S
from ..sources import adapters as AD


from .common import r6


# -- building blocks shared by several queries ----------------------------------------------

def customer_table(spark: SparkSession, d: str) -> DataFrame:
    """Calls -> clean (drop, dates, median/mode fill) -> FE-A -> AGG-2."""
    return (AD.calls(spark, d)
            .transform(C.clean_call_records)
            .transform(FE.call_features_plus_one)
            .transform(A.customer_rollup))


def scored_customers(spark: SparkSession, d: str, with_label: bool = False) -> DataFrame:
    """Customer table joined to the CRM, with the live rule score and band
    (and the 0/1 label from the modal target when asked).  Only the columns that
    the score and the label need are read and filled."""
    needed = AD.calls(spark, d).select(S.ID_COL, "customer_sentiment_score", S.TARGET_COL)
    cust = needed.transform(C.median_fill).transform(A.customer_rollup)
    crm = AD.crm(spark, d)
    j = cust.join(crm, cust.record_no == crm.customer_id, "left")
    # the customer's mean sentiment is compared at 1e-9 resolution, so that the
    # summation order of the mean cannot flip a rule threshold
    score = R.rule_score(F.round("customer_sentiment_score", 9), "account_balance", "risk_factors")
    extra = [F.when(F.col("unpaid_flag") == S.TARGET_UNPAID, 1).otherwise(0).alias("label")] if with_label else []
    return j.select("record_no", "call_count", "customer_sentiment_score", "account_balance",
                    F.coalesce(F.size("risk_factors"), F.lit(0)).alias("n_risk_factors"),
                    score.alias("risk_score"), R.realtime_band(score).alias("risk_category"), *extra)


# -- queries --------------------------------------------------------------------------------

def q_call_records(spark, d):
    return r6(AD.calls(spark, d))


def q_crm_customers(spark, d):
    c = AD.crm(spark, d)
    return c.select("customer_id", "name", "account_balance",
                    "payment_count", F.array_join("risk_factors", ",").alias("risk_factors"),
                    "previous_calls", "satisfaction_score", "segment")


def q_customer_features(spark, d):
    return r6(customer_table(spark, d))


def q_top_risk_customers(spark, d):
    """Flagship: ten customers with the highest live danger score (ties by id)."""
    s = scored_customers(spark, d)
    return r6(s.orderBy(F.col("risk_score").desc(), F.col("record_no").asc()).limit(10))


QUERIES = {
    "call_records": q_call_records,
    "crm_customers": q_crm_customers,
    "customer_features": q_customer_features,
    "top_risk_customers": q_top_risk_customers,
}


def _merge():
    from . import exports, live, models, prepare, scoring, training
    for mod in (prepare, scoring, live, models, exports, training):
        dup = set(mod.QUERIES) & set(QUERIES)
        if dup:
            raise ValueError(f"duplicate query names {dup}")
        QUERIES.update(mod.QUERIES)
        EXTRA_ORACLE.update(mod.ORACLE)


EXTRA_ORACLE: dict = {}
_merge()
