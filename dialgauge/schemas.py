"""Input schemas. Numbers and prefixes are text because their leading zeros matter."""

from pyspark.sql import types as T

VOICE = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("tel_opp_num", T.StringType()),
        T.StructField("tel_opp_head", T.StringType()),
        T.StructField("tel_opp_len", T.IntegerType()),
        T.StructField("tel_start_time", T.LongType()),
        T.StructField("tel_end_time", T.LongType()),
        T.StructField("tel_call_type", T.IntegerType()),
        T.StructField("tel_in_and_out", T.IntegerType()),
    ]
)

SMS = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("smg_opp_num", T.StringType()),
        T.StructField("smg_opp_head", T.StringType()),
        T.StructField("smg_opp_len", T.IntegerType()),
        T.StructField("smg_start_time", T.StringType()),
        T.StructField("smg_in_and_out", T.IntegerType()),
    ]
)

WEB = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("wa_name", T.StringType()),
        T.StructField("visit_cnt", T.LongType()),
        T.StructField("visit_dura", T.LongType()),
        T.StructField("up_flow", T.LongType()),
        T.StructField("down_flow", T.LongType()),
        T.StructField("wa_type", T.IntegerType()),
        T.StructField("wa_date", T.IntegerType()),
    ]
)

LABELS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("label", T.IntegerType())])
