"""Table schemas and the fixed business constants of the library."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the values of the system being replaced for
# results to agree; they are listed plainly, in their natural order.
# ---------------------------------------------------------------------------
RECHECK_AFTER_DAYS = 2          # no owner reply yet -> look again in 2 days
RECHECK_MAX_AGE_DAYS = 10       # stop looking 10 days after publication
SIMILARITY_THRESHOLD = 0.80     # generic owner reply if ratio >= 0.80
MIN_REVIEW_TEXT_LEN = 2         # stripped review text shorter than this is empty
LOW_STARS = (1, 2)              # only 1 and 2 star reviews are kept
FETCH_BUFFER = 50               # extra reviews requested per place on first fetch
BATCH_SIZE = 50                 # places per fetch run, reviews per scorer call
CONTESTED_MIN_REVIEWS = 30
CONTESTED_MAX_SCORE = 4.3
CONTESTED_MIN_ONE_STAR_SHARE = 0.1
CITY_SPELLINGS = ("台北市", "臺北市")
DISTRICT_PATTERN = "(?:台北市|臺北市).*?([一-鿿]{1,4}區)"
UNKNOWN_DISTRICT = "未辨識行政區"
GEO_BOX = {"lat": (24.8, 25.3), "lng": (121.2, 122.0)}
DISPLAY_NAME_LIMIT = 26
DISPLAY_NAME_SEPARATORS = ("｜", "|", " 好吃", " 人氣", " 熱門", " 特色", " 上班族", " 外送")
ELLIPSIS = "…"
TRUNCATE_LIMIT = 190
NO_REVIEW_TEXT = "尚無低星吵架評論"
NO_OWNER_REPLY = "店家尚未回覆"
HOSTILE_WORDS = ("不要來", "不缺", "不爽")
INTENSITY_EDGES = (0.0, 3.0, 5.0, 7.0, 9.0, 10.1)
INTENSITY_LABELS = ("1–3 理性", "4–5 升溫", "6–7 激烈", "8–9 火爆", "10 史詩")
EVEN_MATCH_GAP = 0.5
PAGE_SIZE_MAX = 3
EMOTION_TAGS = (
    "理性客觀 (陳述事實/給予建議)",
    "高級反串 (表面客氣暗藏嘲諷)",
    "暴躁老哥 (直接開嗆、情緒勒索)",
    "無聊公關 (制式道歉)",
    "高情商幽默",
)
GENERIC_REPLY_TEMPLATES = (
    "非常抱歉讓您有不愉快的用餐體驗，我們會持續改善。",
    "感謝您的寶貴意見，我們會持續改進服務品質。",
    "很抱歉此次消費體驗未能符合您的期待，我們會重新檢視流程。",
    "謝謝您願意提供意見，我們會持續努力提供更好的服務。",
    "對於造成您的不便，我們深感抱歉，並會持續改善。",
    "感謝您的回饋，我們已收到並會進一步了解狀況。",
)
# scorer finish reason -> status text (the text after the code is the message)
FINISH_MESSAGES = {
    "STOP": "SUCCESS",
    "MAX_TOKENS": "MAX_TOKENS：輸入過多資料或AI回覆過多，導致超過模型單次輸出的最大Token上限。",
    "SAFETY": "SAFETY：評論或 AI 生成的回覆中，觸發了 Google 官方的安全過濾器（例如包含極度嚴重的仇恨言論、色情、暴力或騷擾文字）。",
    "RECITATION": "RECITATION：為了避免侵犯版權，觸發保護機制而停止。",
}
FINISH_OTHER_SUFFIX = "：Google 伺服器端發生突發性的內部錯誤或網路波動。"
STATUS_MESSAGE_MARKER = "You can"
# ---------------------------------------------------------------------------

S = T.StringType()
I = T.IntegerType()
D = T.DoubleType()
B = T.BooleanType()
TS = T.TimestampNTZType()   # all stored instants are UTC wall-clock values

PLACE = T.StructType([
    T.StructField("place_id", S, False),
    T.StructField("title", S, False),
    T.StructField("category", S, False),
    T.StructField("categories", S, False),
    T.StructField("address", S, True),
    T.StructField("lat", D, False),
    T.StructField("lng", D, False),
    T.StructField("store_url", S, False),
    T.StructField("image_url", S, True),
    T.StructField("business_status", S, False),
    T.StructField("scraped_at", TS, False),
    T.StructField("google_score", D, False),
    T.StructField("reviews_count", I, False),
    T.StructField("one_star", I, False),
    T.StructField("two_star", I, False),
    T.StructField("three_star", I, False),
    T.StructField("four_star", I, False),
    T.StructField("five_star", I, False),
    T.StructField("blocked", B, False),
    T.StructField("skip_review_fetch", B, False),
])

REVIEW = T.StructType([
    T.StructField("review_id", S, False),
    T.StructField("place_id", S, False),
    T.StructField("original_language", S, False),
    T.StructField("review_text", S, False),
    T.StructField("published_at", TS, False),
    T.StructField("review_url", S, False),
    T.StructField("review_image_urls", S, True),
    T.StructField("likes_count", I, False),
    T.StructField("total_score", D, False),
    T.StructField("stars", I, False),
    T.StructField("owner_reply_date", TS, True),
    T.StructField("owner_reply", S, True),
    T.StructField("scraped_at", TS, False),
    T.StructField("owner_reply_recheck", B, False),
    T.StructField("owner_reply_recheck_at", TS, True),
    T.StructField("next_check_at", TS, True),
])

ANALYSIS = T.StructType([
    T.StructField("review_id", S, False),
    T.StructField("place_id", S, False),
    T.StructField("review_text", S, False),
    T.StructField("review_summary", S, False),
    T.StructField("review_sentiment", S, False),
    T.StructField("review_score", I, False),
    T.StructField("owner_text", S, False),
    T.StructField("owner_summary", S, False),
    T.StructField("owner_sentiment", S, False),
    T.StructField("owner_score", I, False),
    T.StructField("pr_reply", S, False),
    T.StructField("request_json", S, False),
    T.StructField("response_json", S, True),
])

EXECUTION_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("pipeline", S, False),
    T.StructField("status", S, False),
    T.StructField("items_count", I, False),
    T.StructField("run_id", S, True),
    T.StructField("dataset_id", S, True),
    T.StructField("actor_name", S, True),
    T.StructField("started_at", TS, False),
    T.StructField("finished_at", TS, True),
    T.StructField("request_json", S, True),
    T.StructField("response_json", S, True),
    T.StructField("error_msg", S, True),
    T.StructField("retry_count", I, False),
])

POST_LOG = T.StructType([
    T.StructField("id", S, False),
    T.StructField("text", S, True),
    T.StructField("media_type", S, False),
    T.StructField("media_url", S, True),
    T.StructField("timestamp", TS, False),
    T.StructField("permalink", S, False),
])

# Raw review object as delivered by the scraper (all keys optional).
RAW_REVIEW = T.StructType([
    T.StructField("reviewId", S), T.StructField("placeId", S),
    T.StructField("text", S), T.StructField("stars", S),
    T.StructField("publishedAtDate", S), T.StructField("publishAt", S),
    T.StructField("likesCount", S), T.StructField("reviewUrl", S),
    T.StructField("reviewOrigin", S),
    T.StructField("reviewImageUrls", T.ArrayType(S)),
    T.StructField("responseFromOwnerDate", S), T.StructField("responseFromOwnerText", S),
    T.StructField("originalLanguage", S), T.StructField("language", S),
    T.StructField("totalScore", S), T.StructField("title", S),
    T.StructField("searchString", S), T.StructField("reviewerId", S),
    T.StructField("name", S), T.StructField("address", S),
    T.StructField("categoryName", S), T.StructField("reviewsCount", S),
    T.StructField("url", S), T.StructField("scrapedAt", S),
    T.StructField("startedAt", S),
    T.StructField("location", T.StructType([T.StructField("lat", D), T.StructField("lng", D)])),
])

RAW_PLACE = T.StructType([
    T.StructField("placeId", S), T.StructField("title", S),
    T.StructField("categoryName", S), T.StructField("address", S),
    T.StructField("street", S), T.StructField("city", S),
    T.StructField("postalCode", S), T.StructField("state", S),
    T.StructField("countryCode", S), T.StructField("url", S),
    T.StructField("imageUrl", S), T.StructField("searchString", S),
    T.StructField("language", S), T.StructField("scrapedAt", S),
    T.StructField("categories", T.ArrayType(S)),
    T.StructField("location", T.StructType([T.StructField("lat", D), T.StructField("lng", D)])),
    T.StructField("totalScore", D), T.StructField("reviewsCount", T.LongType()),
    T.StructField("imagesCount", T.LongType()), T.StructField("rank", T.LongType()),
    T.StructField("permanentlyClosed", B), T.StructField("temporarilyClosed", B),
    T.StructField("openingHours", T.ArrayType(T.StructType([
        T.StructField("day", S), T.StructField("hours", S)]))),
    T.StructField("additionalInfo", T.MapType(S, T.ArrayType(T.MapType(S, B)))),
    T.StructField("reviewsDistribution", T.StructType([
        T.StructField("oneStar", T.LongType()), T.StructField("twoStar", T.LongType()),
        T.StructField("threeStar", T.LongType()), T.StructField("fourStar", T.LongType()),
        T.StructField("fiveStar", T.LongType())])),
])

SCORER_OUTPUT = T.StructType([
    T.StructField("review_id", S), T.StructField("place_id", S),
    T.StructField("review_text", S), T.StructField("review_summary", S),
    T.StructField("review_sentiment", S), T.StructField("review_score", I),
    T.StructField("owner_text", S), T.StructField("owner_summary", S),
    T.StructField("owner_sentiment", S), T.StructField("owner_score", I),
    T.StructField("pr_reply", S),
])
