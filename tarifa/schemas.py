"""Column types of products, matches and comparison rows."""

from __future__ import annotations

from pyspark.sql import types as T

SPEC = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("unit_text", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("qty_base", T.DoubleType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("total_base", T.DoubleType()),
    ]
)
RAW_FIELDS = ("sku_id", "title", "price", "brand", "category", "barcode", "spec_text", "origin_price", "city", "store", "url", "image_url", "collected_at")
VERDICT = T.StructType(
    [
        T.StructField("self_uid", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("is_match", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)
PAIR_COLUMNS = ("self_uid", "platform", "platform_ord", "rival_uid", "score", "level", "confidence", "reason", "need_review")

SELF = "self"
# fixed values: names of match levels and actions
BARCODE, BRAND_SPEC, FUZZY, JUDGED, MANUAL, NONE = "L1-条码", "L1-品牌规格", "L2-模糊", "L3-AI判定", "人工确认", "未匹配"
CUT_URGENT, CUT, WATCH, RAISE, NO_DATA = "建议降价(高优)", "建议降价", "持平/关注", "有提价空间", "数据不足"
ACTION_KINDS = {CUT_URGENT: "critical", CUT: "serious", WATCH: "neutral", RAISE: "good", NO_DATA: "muted"}
