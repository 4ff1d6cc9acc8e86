"""Values that fix the meaning of the results: word lists, patterns, thresholds, formats."""

# --- fixed values: input schema -------------------------------------------------
REQUIRED_COLUMNS = ["review_id", "text", "lang", "recommended", "playtime_hours", "posted_at"]

# --- fixed values: character classes for the intactness score --------------------
MOJIBAKE_CHARS = "ÂÃâãÅÄÆÇèéêëÌÍÎÏðñòóôõö÷øùúûü°ª¬«»¿¡§©®™"
HANGUL_CHARS = "가-힣"
ASCII_LETTERS = "A-Za-z"
PLAIN_PUNCTUATION = ".,!?'\"()\\-:;/&%$#@*+="
MOJIBAKE_WEIGHT = 3

# Unicode white space, as a set of characters to trim.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: spam rule ------------------------------------------------------
URL_PATTERN = (
    r"(?:https?://|www\.|bit\.ly|t\.co|tinyurl|"
    r"[a-z0-9-]+\.(?:com|net|org|io|gg|kr|cn|ru|info|biz)\b)"
)
TARGET_SPAM_RATIO = 0.06
MIN_POSITIVE_SIMILARITY = 0.32
MIN_SIMILARITY_GAP = 0.03
URL_SCORE_BOOST = 0.10

POSITIVE_PROTOTYPES = [
    "외부 사이트로 유도하는 광고 또는 프로모션 메시지로 구매를 권유함",
    "게임 아이템·계정·재화의 현금거래를 알선하거나 카톡·연락처로 거래 유도",
    "URL이나 외부 링크가 본문 대부분을 차지하는 홍보성 짧은 글",
    "유료 후원, 스폰서, 광고비를 받고 작성된 리뷰임을 명시하는 문장",
    "봇이 자동 생성한 의미 없는 반복 텍스트, 이모지 도배, 무관한 키워드 나열",
]
NEGATIVE_PROTOTYPES = [
    "게임을 직접 플레이해 본 경험에 기반한 솔직한 감상과 평가",
    "게임의 그래픽, 스토리, 캐릭터, 시스템, 난이도 등 구체적 요소에 대한 의견",
    "게임을 추천하거나 비추천하는 짧지만 진정성 있는 한 줄 평",
]

# --- fixed values: clustering -----------------------------------------------------
PCA_DIM = 50
K_MIN = 6
K_MAX = 10
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
KMEANS_TOLERANCE = 1e-4
SEED = 42
MIN_CLUSTER_SIZE = 20
OTHER_CLUSTER_ID = -1
REPRESENTATIVES_PER_CLUSTER = 10
MMR_LAMBDA = 0.6
NORM_EPSILON = 1e-12

# --- fixed values: complaints -----------------------------------------------------
MIN_NEGATIVES = 5
NEGATIVE_SAMPLE_SIZE = 20
NEGATIVE_NEAREST = 10

# --- fixed values: text lengths ---------------------------------------------------
EXAMPLE_CHARS = 120
TOPIC_PROMPT_CHARS = 400
ISSUE_PROMPT_CHARS = 350
REPORT_QUOTE_CHARS = 200
TICKET_QUOTE_CHARS = 300
ELLIPSIS = "…"
MAX_REPAIR_EXAMPLES = 5
REPORT_QUOTES = 3
VIEW_QUOTES = 5
TICKET_QUOTES = 3
TABLE_QUOTE_IDS = 2
PAGE_SIZE = 50
EMBED_BATCH = 256
TICKETS_A_REQUEST = 1000

# --- fixed values: lookup tables --------------------------------------------------
SEVERITY_PRIORITY = {"critical": "Highest", "major": "High", "minor": "Medium"}
DEFAULT_PRIORITY = "Medium"
SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2}
DEFAULT_SEVERITY_RANK = 9
SEVERITY_LABEL = {"critical": "🔴 Critical", "major": "🟠 Major", "minor": "🟡 Minor"}
SENTIMENT_BADGE = {"positive": "🟢 긍정", "negative": "🔴 부정", "mixed": "🟡 혼합"}
SENTIMENT_ICON = {"positive": "🟢", "negative": "🔴", "mixed": "🟡"}
DEFAULT_ICON = "⚪"
RECOMMENDED_FLAG = "👍추천"
NOT_RECOMMENDED_FLAG = "👎비추천"

# USD per one million tokens: (input, output)
MODEL_PRICES = {
    "text-embedding-3-small": (0.020, 0.0),
    "text-embedding-3-large": (0.130, 0.0),
    "gpt-4o-mini": (0.150, 0.600),
    "gpt-4.1-nano": (0.100, 0.400),
    "gpt-4.1-mini": (0.400, 1.600),
}

# --- fixed values: defaults for missing response keys -----------------------------
MISSING_TOPIC = "(미정)"
MISSING_TOPIC_EN = "(unknown)"
DEFAULT_SENTIMENT = "mixed"
DEFAULT_SEVERITY = "minor"
FAILED_TOPIC = "클러스터 "
FAILED_TOPIC_EN = "Cluster "
FAILED_SUMMARY = "LLM 호출 실패: "
FAILED_SUMMARY_EN = "LLM call failed: "
FAILED_ISSUE = "LLM 호출 실패"
FAILED_ISSUE_EN = "LLM failure"

# --- fixed values: report and ticket wording --------------------------------------
REPORT_TITLE = "# Steam 리뷰 분석 리포트"
KPI_HEADING = "## 📊 KPI 요약"
TOPICS_HEADING = "## 🎯 주제별 분석"
ISSUES_HEADING = "#### 🚨 주요 불만 이유"
ISSUE_TABLE_HEADER = (
    "| # | 심각도 | 빈도 | 이슈 (KO) | 이슈 (EN) | 대표 리뷰 |\n"
    "|---|---|---|---|---|---|\n"
)
TICKET_SUMMARY_PREFIX = "[CX/리뷰분석] "
TICKET_LABELS = ["cx-review", "auto-extracted"]
TICKET_ISSUE_TYPE = "Bug"
TICKET_PROJECT = "GAME"
