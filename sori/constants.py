"""Names, orders and thresholds that results depend on."""

#: Attributes in their order, with the names used in ids.
ASPECTS = {"색상": "COLOR", "사이즈": "SIZE", "소재": "MATERIAL", "파손": "DAMAGE", "오배송": "MISDELIVERY", "기타": "ETC"}
#: Attributes whose causes are diagnosed.
SCOPE = ("색상", "사이즈", "소재")
CHANNELS = ("COUPANG", "NAVER", "ZIGZAG")
NORMAL, BIASED, GLOBAL, TENTATIVE, INDETERMINATE = "정상", "편중형", "전역형", "잠정 전역형", "구분불가"
#: Recommended actions.
ACTIONS = {
    "recommend": "개선안 생성",
    "channel": "채널 운영 요소 점검 권장",
    "파손": "물류 점검 권장",
    "오배송": "운영 점검 권장",
    "product": "상품 자체 점검 권장",
    "undetermined": "편중·전역 구분 불가(채널 표본 부족)",
    "기타": "기타 유형",
}
HIGH, MEDIUM, LOW, NOT_APPLICABLE = "높음", "중간", "낮음", "해당없음"
#: Windows in days, thresholds of the tests and of alerts.
CURRENT_DAYS, PAST_DAYS = 7, 28
MIN_SAMPLE, MIN_DELTA, FDR_Q = 10, 0.03, 0.05
CONSISTENT_RATIO, CONSISTENT_COUNT = 0.5, 5
RENOTIFY_DAYS, RENOTIFY_JUMP = 7, 0.05
DRIFT_RISK, JSD_MIN, JSD_CRISIS, JSD_TOTAL = 0.03, 0.10, 0.20, 30
#: How the two sources' signals read.
READINGS = {"both": "강한 신호(양 소스)", "cs": "CS 선행 신호 — 리뷰는 시차로 미반영 가능", "review": "리뷰 지연 반영 또는 CS 미표출"}
#: Causes that neither text nor image can solve.
UNSOLVABLE = ("실물_염색_편차", "실제_원단_문제")
#: Attributes that reviews may be about, and names of sentiments and attributes that answers may use.
REVIEW_ASPECTS = ("색상", "사이즈", "소재")
SENTIMENT_NAMES = {"1": 1, "+1": 1, "긍정": 1, "positive": 1, "-1": -1, "부정": -1, "negative": -1, "0": 0, "중립": 0, "neutral": 0}
