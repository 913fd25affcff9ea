"""Column names, schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's for equal results).
# ---------------------------------------------------------------------------
TARGET_UNPAID = "未払"          # unpaid -> label 1
TARGET_PAID = "支払済"          # paid -> label 0

# Column names of the original workbook and their ASCII physical names.
ORIGINAL_NAMES = {
    "record_no": "レコード番号",
    "unpaid_flag": "未払FLAG",
    "contract_date": "成約日date",
    "start_ts": "開始タイムスタンプjst",
    "contact_id": "コンタクト_id",
    "agent": "エージェント",
    "sales_rep": "営業担当者",
    "content_list": "content_list",
    "days_call_to_contract": "電話日-成約日",
    "agent_talktime_text": "agent_talktime通話時間",
    "customer_talktime_text": "customer_talktime通話時間",
    "total_talktime_text": "total_talktime通話時間",
    "total_conversation_duration_text": "total_conversation_duration合計",
    "annual_income": "年収",
    "years_employed": "勤続年数",
    "age": "年齢",
    "loan_amount": "借入額",
    "monthly_income": "月収",
    "family_size": "家族構成",
    "has_mortgage": "住宅ローン",
    "credit_score": "クレジットスコア",
    "past_delinquencies": "過去延滞回数",
    "call_seconds": "通話時間秒",
    "call_no": "通話回数",
    "debt_to_income": "債務収入比率",
    "monthly_burden": "月次債務負担",
    "age_band": "年齢グループ",
    "credit_band": "クレジット区分",
}

ID_COL = "record_no"
TARGET_COL = "unpaid_flag"
DATE_COLUMNS = ("contract_date", "start_ts")
DROP_COLUMNS = ("start_ts", "contact_id", "agent", "sales_rep", "content_list")
# Any of these present -> call-centre path, else financial-profile path.
CALL_INDICATORS = ("agent_sentiment_score", "customer_sentiment_score",
                   "agent_talktime", "customer_talktime", "total_conversation_duration")
# Aggregation name rule: lower-cased name containing one of these is summed.
SUM_NAME_MARKERS = ("sentence", "count")

# Bins of the financial profile, right-closed (a, b].
AGE_BINS = (0, 30, 40, 50, 60, 100)
CREDIT_BINS = (0, 550, 650, 750, 850)

# Rule score of the live path.
RULE_BASE = 50.0
RULE_SENTIMENT_VERY_NEG = -0.5
RULE_SENTIMENT_NEG = 0.0
RULE_VERY_NEG_POINTS = 20.0
RULE_NEG_POINTS = 10.0
RULE_LOW_BALANCE = 5000.0
RULE_LOW_BALANCE_POINTS = 15.0
RULE_HIGH_BALANCE = 30000.0
RULE_HIGH_BALANCE_POINTS = -10.0
RULE_POINTS_PER_FACTOR = 5.0
RULE_CONFIDENCE = 0.85
REALTIME_VECTOR_SIZE = 25
REALTIME_DEFAULTS = (0.0, 0.0, 0.0, 0.5, 0.1)   # agent/customer sentiment, duration, talk ratio, silence
SATISFACTION_DEFAULT = 3.0

BATCH_LABELS = ("Low Risk", "Medium Risk", "High Risk")
REALTIME_LABELS = ("高リスク", "中リスク", "低リスク")
MOBILE_LABELS = ("🔴 高リスク", "🟡 中リスク", "🟢 低リスク")
WIDGET_LABELS = ("High Risk", "Medium Risk", "Low Risk")
SENTIMENT_LABELS = ("Positive", "Neutral", "Negative")

AGENT_RECOMMENDATIONS = {
    "high": ["🚨 高リスク顧客 - 上司にエスカレーションしてください",
             "💰 支払いプランのオプションを提示してください",
             "📋 支払いに関する懸念を詳細に記録してください"],
    "medium": ["⚠️ 支払い約束を注意深く監視してください",
               "🤝 信頼関係を築いてください",
               "📞 フォローアップコールをスケジュールしてください"],
    "low": ["✅ 顧客は良好な支払い可能性を示しています",
            "🎯 アップセリング機会に焦点を当ててください",
            "😊 良好な関係を維持してください"],
}
AGENT_UNHAPPY_RECOMMENDATION = "😟 顧客が不満を感じているようです - 懸念事項に対処してください"
UNHAPPY_SENTIMENT = -0.3

MOBILE_RECOMMENDATIONS = {
    "high": ["🚨 最優先: すぐにスーパーバイザーにエスカレーション",
             "💰 柔軟な支払いプランオプションを提案",
             "📋 すべての支払い懸念を詳細に記録",
             "🤝 共感的な言葉遣いと積極的な傾聴を使用",
             "⏰ 通話時間を制限 - 迅速にコミットメントを取得"],
    "medium": ["⚠️ 支払いコミットメントを密接に監視",
               "🤝 関係を築き信頼を確立",
               "📞 明確なフォローアップ通話をスケジュール",
               "💡 明確な支払いオプションを提示",
               "📝 条件の理解を確認"],
    "low": ["✅ 顧客は良好な支払い潜在能力を示しています",
            "🎯 アップセルの機会に焦点を当てる",
            "😊 前向きな関係を維持",
            "📈 プレミアムサービスの提供を検討",
            "🏆 ロイヤルティプログラムの優秀候補"],
}
MOBILE_PRIORITY = {"high": "high-priority", "medium": "medium-priority", "low": ""}

RISK_FACTOR_NEGATIVE_SENTIMENT = "顧客感情がネガティブ"
RISK_FACTOR_LOW_BALANCE = "口座残高が低い"
RISK_FACTOR_MANY_PAST = "複数の過去のリスク要因"
MANY_PAST_FACTORS = 2

# Call routing (strict comparisons).
ROUTE_HIGH_ABOVE = 70.0
ROUTE_MEDIUM_ABOVE = 40.0
ROUTE_HIGH_FLOW = "HighRiskFlow"
ROUTE_MEDIUM_FLOW = "MediumRiskFlow"
ROUTE_LOW_FLOW = "LowRiskFlow"
ROUTE_STANDARD_MESSAGE = "Please hold while I connect you with the best available agent."

# Call sentiment summary over the transcript buffer.
SEGMENT_BUFFER = 10
SUMMARY_RESOLVED_ABOVE = 5
SUMMARY_FOLLOW_UP_ABOVE = 8
SUMMARY_CALL_TYPE = "PAYMENT_INQUIRY"
SUMMARY_TOPICS = ["payment_plan", "account_balance", "financial_assistance"]

# Live-session timing.
RESCORE_PERIOD_SECONDS = 10
RESCORE_MIN_AGE_SECONDS = 30
ATTRIBUTE_REFRESH_SECONDS = 5   # contact attributes of an open call are refreshed this often
SCORE_CACHE_TTL_SECONDS = 3600
DEBOUNCE_MILLISECONDS = 500
CONTACT_TRIGGER_EVENT = "AGENT_CONNECTED"

# Model defaults.
BOOSTED_PARAMS = dict(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                      featureSubsetStrategy="0.8", seed=42)
SPLIT_SEED = 42
TEST_FRACTION_HEX = "33333333"      # first 8 hex digits of md5 below this -> 20 %
FOLD_CUTS_HEX = ("33333333", "66666666", "99999999", "cccccccc")

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
SEGMENT_SCHEMA = T.StructType([
    T.StructField("contact_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("sentiment", T.StructType([
        T.StructField("sentiment", T.StringType()),
        T.StructField("positive_score", T.DoubleType()),
        T.StructField("negative_score", T.DoubleType()),
        T.StructField("neutral_score", T.DoubleType()),
    ])),
    T.StructField("segment_id", T.LongType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("call_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("agent_sentiment", T.DoubleType()),
    T.StructField("customer_sentiment", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

CRM_RECORD_SCHEMA = T.StructType([
    T.StructField(name, T.StructType([T.StructField("value", typ)]))
    for name, typ in [
        ("customer_id", T.StringType()), ("name", T.StringType()), ("phone", T.StringType()),
        ("email", T.StringType()), ("account_balance", T.StringType()),
        ("payment_history", T.ArrayType(T.StringType())),
        ("risk_factors", T.ArrayType(T.StringType())),
        ("previous_calls", T.StringType()), ("satisfaction_score", T.StringType()),
    ]
])

CONTACT_EVENT_SCHEMA = T.StructType([
    T.StructField("detail", T.StructType([
        T.StructField("contactId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("agentId", T.StringType()),
        T.StructField("eventTimestamp", T.StringType()),
        T.StructField("attributes", T.StructType([T.StructField("customer_id", T.StringType())])),
    ])),
])
