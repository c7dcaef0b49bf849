"""Stand-ins for the three event tables and the roster on the test tables (FIXTURES.md, section 2).

The texts run unchanged in Spark and DuckDB. ``{events}``, ``{lineitem}``, ``{customer}`` are filled
with table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOICE = """
select concat('u', lpad(cast(user_id as string), 4, '0')) as uid,
       lpad(cast(k as string), 3, '0') as tel_opp_num,
       case when event_id % 211 = 0 then null
            else split_part('139,130,189,000,106,138,131,180,955,158', ',', k % 10 + 1) end as tel_opp_head,
       3 + k % 15 as tel_opp_len,
       cast(day(ts) * 1000000 + hour(ts) * 10000 + minute(ts) * 100 + second(ts) as bigint) as tel_start_time,
       cast(day(te) * 1000000 + hour(te) * 10000 + minute(te) * 100 + second(te) as bigint) as tel_end_time,
       case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3
                       when 'purchase' then 4 else 5 end as tel_call_type,
       case when user_id % 10 = 0 then 1 when user_id % 10 = 1 then 0 else cast(event_id % 2 as int) end as tel_in_and_out
from (select *, ts + cast(floor(value * 10) as int) * interval '1' second as te,
             cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e
"""

SMS = """
select concat('u', lpad(cast(user_id as string), 4, '0')) as uid,
       lpad(cast((k * 7) % 60 as string), 3, '0') as smg_opp_num,
       case when event_id % 197 = 0 then null
            else split_part('000,106,139,132,153,100,186,187,133,955', ',', (k * 3) % 10 + 1) end as smg_opp_head,
       3 + (k * 7) % 16 as smg_opp_len,
       lpad(cast(day(ts) * 1000000 + hour(ts) * 10000 + minute(ts) * 100 + second(ts) as string), 8, '0') as smg_start_time,
       case when user_id % 10 = 2 then 1 when user_id % 10 = 3 then 0 else cast((event_id + user_id) % 2 as int) end as smg_in_and_out
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events} where event_type <> 'error') e
where user_id % 12 <> 5
"""

WEB = """
select concat('u', lpad(cast(l_suppkey as string), 4, '0')) as uid,
       case when l_orderkey % 97 = 0 then null
            when l_linenumber > 5 then concat('site', cast(l_partkey % 500 as string))
            else concat('app', cast(l_partkey % 50 as string)) end as wa_name,
       cast(l_quantity as bigint) as visit_cnt,
       case l_linenumber when 1 then cast(floor(f / 10000) as bigint) when 2 then cast(floor(f / 100) as bigint)
            when 3 then cast(floor(f / 10) as bigint) when 4 then f when 5 then f * 10 when 6 then f * 100
            else f * 1000 end as visit_dura,
       cast(floor(f / 7) as bigint) as up_flow,
       f * 3 as down_flow,
       case when l_suppkey % 10 = 0 then 1 when l_suppkey % 10 = 1 then 0 else l_linenumber % 2 end as wa_type,
       cast(1 + l_orderkey % 45 as int) as wa_date
from (select *, cast(floor(l_extendedprice) as bigint) as f from {lineitem}) l
"""

ROSTER = """
select concat('u', lpad(cast(c_custkey as string), 4, '0')) as uid,
       case when c_custkey % 8 < 5 then case when c_custkey % 11 < 2 then 1 else 0 end end as label
from {customer} where c_custkey < (select (max(user_id) + 1) * 4 / 3 from {events})
"""

# Thresholds for this volume (FIXTURES.md, section 2).
VOICE_HOT = 110
SMS_BAND = (100, 135)
WEB_HOT = 870
MIN_BAD, MAX_GOOD = 6, 14

# A manifest as one fit would store it: days, prefixes, lengths and numbers that the stand-ins can
# hold, and a few names of either list.
_DAYS = [str(i) for i in range(1, 46)]
_SMS_SHORT = sorted({f"{k * 7 % 60:03d}" for k in range(100) if 3 + k * 7 % 16 <= 7})
MANIFESTS = {
    "voice": {
        "type": ["1", "2", "3", "4", "5"],
        "day": _DAYS,
        "head": ["000", "106", "130", "131", "138", "139", "158", "180", "189", "955"],
        "len": [str(i) for i in range(3, 18)],
        "short": [f"{k:03d}" for k in range(100) if 3 + k % 15 <= 5],
    },
    "sms": {
        "day": _DAYS,
        "head": ["000", "100", "106", "132", "133", "139", "153", "186", "187", "955"],
        "len": [str(i) for i in range(3, 19)],
        "short": _SMS_SHORT,
    },
    "wa": {
        "bad": [f"site{i}" for i in range(0, 500, 25)],
        "hot": [f"app{i}" for i in range(50)],
    },
}

# Families and seeds of the stand-in scores.
SCORE_SEEDS = {"deep": [0, 7, 14], "shallow": [0, 1, 2]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOICE, events=_table(spark, sf_dir, "events"))


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SMS, events=_table(spark, sf_dir, "events"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEB, lineitem=_table(spark, sf_dir, "lineitem"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        ROSTER, customer=_table(spark, sf_dir, "customer"), events=_table(spark, sf_dir, "events")
    )


def score_share(family: str, seed: int) -> str:
    """Stand-in score: the share of a user's calls that meet a condition on length or hour."""
    hit = f"(tel_opp_len + {seed}) % 5 < 2" if family == "deep" else f"(tel_hour + {seed}) % 4 < 2"
    return f"avg(case when {hit} then 1e0 else 0e0 end)"


def scores(calls: DataFrame) -> DataFrame:
    """(uid, family, seed, score) from calls with their derived fields, in one pass."""
    from pyspark.sql import functions as F

    pairs = [(family, seed) for family, seeds in SCORE_SEEDS.items() for seed in seeds]
    wide = calls.groupBy("uid").agg(*[F.expr(score_share(f, s)).alias(f"{f}_{s}") for f, s in pairs])
    entries = ", ".join(f"'{f}', {s}, {f}_{s}" for f, s in pairs)
    return wide.selectExpr("uid", f"stack({len(pairs)}, {entries}) as (family, seed, score)")
