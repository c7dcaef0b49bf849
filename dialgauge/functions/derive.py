"""Row-level derivations: packed times, class codes, rates.

Functions over a column return SQL text, so that they can stand in a ``select`` as well as in the
``FILTER`` clause of an aggregate; the ``with_*`` functions apply them to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import quoted_list

# Number prefixes of the three operators, and the prefix of foreign senders.
YIDONG = ["139", "138", "137", "159", "151", "158", "150", "136", "187", "182"]
LIANTONG = ["130", "132", "131", "186"]
DIANXIN = ["189", "180", "133", "156", "153"]
FOREIGN = ["000"]

# 45 days in nine bags of five.
BAG_DAYS = 5
BAG_COUNT = 9


# ---- packed DDHHMMSS numbers -------------------------------------------------------------------


def day_of(t: str) -> str:
    """Day number of a packed time."""
    return f"cast({t} div 1000000 as int)"


def hour_of(t: str) -> str:
    """Hour of a packed time."""
    return f"cast({t} div 10000 % 100 as int)"


def seconds_of(t: str) -> str:
    """Seconds since the start of day 0 of a packed time."""
    return f"(({t} div 1000000) * 86400 + ({t} div 10000 % 100) * 3600 + ({t} div 100 % 100) * 60 + {t} % 100)"


def call_seconds(start: str, end: str) -> str:
    """Length of a call in seconds, also across midnight."""
    return f"({seconds_of(end)} - {seconds_of(start)})"


# ---- classes -----------------------------------------------------------------------------------


def day_bag(day: str) -> str:
    """Bag of a day, 0..8; NULL outside the 45 days."""
    return f"case when {day} between 1 and {BAG_COUNT * BAG_DAYS} then cast(({day} - 1) div {BAG_DAYS} as int) end"


def bag_condition(day: str, bag: int) -> str:
    """Days of one bag."""
    return f"{day} between {bag * BAG_DAYS + 1} and {(bag + 1) * BAG_DAYS}"


def number_length_conditions(length: str) -> dict[str, str]:
    """P5: the four classes of number length."""
    return {
        "less_5": f"{length} <= 5",
        "less_11": f"{length} > 5 and {length} < 11",
        "equal_11": f"{length} = 11",
        "over_11": f"{length} > 11",
    }


def number_length_class(length: str) -> str:
    whens = " ".join(f"when {c} then '{n}'" for n, c in number_length_conditions(length).items())
    return f"case {whens} end"


def hour_class_conditions(hour: str) -> list[str]:
    """The five hour classes. Hour 17 belongs to the fourth and the fifth."""
    return [
        f"{hour} <= 8",
        f"{hour} > 8 and {hour} <= 12",
        f"{hour} > 12 and {hour} <= 14",
        f"{hour} > 14 and {hour} <= 17",
        f"{hour} >= 17",
    ]


def call_length_conditions(seconds: str) -> dict[str, str]:
    """Up to two minutes, up to ten, longer."""
    return {
        "short": f"{seconds} <= 120",
        "mid": f"{seconds} > 120 and {seconds} <= 600",
        "long": f"{seconds} > 600",
    }


def call_length_class(seconds: str) -> str:
    whens = " ".join(f"when {c} then '{n}'" for n, c in call_length_conditions(seconds).items())
    return f"case {whens} end"


def duration_decade(value: str) -> str:
    """Decade of a duration, 0 (below 10) .. 7 (10 million and more)."""
    limits = " ".join(f"when {value} < {10 ** (k + 1)} then {k}" for k in range(7))
    return f"case {limits} when {value} is not null then 7 end"


def operator_class(prefix: str, foreign: bool) -> str:
    """Operator of a number prefix. A missing prefix is ``other``.

    With ``foreign`` the foreign prefix is a class of its own (SMS); without, it is ``other`` (voice).
    """
    extra = f"when {prefix} in ({quoted_list(FOREIGN)}) then 'foreign'" if foreign else ""
    return (
        f"case when {prefix} in ({quoted_list(YIDONG)}) then 'yidong'"
        f" when {prefix} in ({quoted_list(LIANTONG)}) then 'liantong'"
        f" when {prefix} in ({quoted_list(DIANXIN)}) then 'dianxin' {extra} else 'other' end"
    )


# ---- tables ------------------------------------------------------------------------------------


def with_call_fields(voice: DataFrame) -> DataFrame:
    """P1, P2, P9 on voice: ``tel_len, tel_date, tel_hour, tel_operator``. Rows without a user go."""
    return voice.filter("uid is not null").withColumns(
        {
            "tel_len": F.expr(call_seconds("tel_start_time", "tel_end_time")),
            "tel_date": F.expr(day_of("tel_start_time")),
            "tel_hour": F.expr(hour_of("tel_start_time")),
            "tel_operator": F.expr(operator_class("tel_opp_head", foreign=False)),
        }
    )


def with_sms_fields(sms: DataFrame) -> DataFrame:
    """P3, P9 on SMS: ``smg_date, smg_hour, smg_operator``."""
    return sms.filter("uid is not null").withColumns(
        {
            "smg_date": F.expr("cast(substring(smg_start_time, 1, 2) as int)"),
            "smg_hour": F.expr("cast(substring(smg_start_time, 3, 2) as int)"),
            "smg_operator": F.expr(operator_class("smg_opp_head", foreign=True)),
        }
    )


def with_web_fields(wa: DataFrame) -> DataFrame:
    """P10 on web access: seconds per visit, total flow, three speeds. No visits gives NULL."""
    return (
        wa.filter("uid is not null")
        .withColumns(
            {
                "visit_per_dura": F.expr("try_divide(visit_dura, visit_cnt)"),
                "flow_amount": F.expr("up_flow + down_flow"),
                "download_speed": F.expr("try_divide(down_flow + 1, visit_dura + 1)"),
                "upload_speed": F.expr("try_divide(up_flow + 1, visit_dura + 1)"),
            }
        )
        .withColumn("amount_speed", F.col("download_speed") + F.col("upload_speed"))
    )


def slice_rows(rows: DataFrame, column: str, value: int) -> DataFrame:
    """Rows of one direction (1 in, 0 out) or one access type (0 web, 1 app)."""
    return rows.filter(F.col(column) == value)


def truncate_features(features: DataFrame, key: str = "uid") -> DataFrame:
    """Every numeric feature as an integer, cut toward zero."""
    numeric = {f.name for f in features.schema if isinstance(f.dataType, T.NumericType)} - {key}
    return features.select([F.col(c).cast("bigint").alias(c) if c in numeric else F.col(c) for c in features.columns])
