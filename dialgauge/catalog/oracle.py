"""The same results in SQL, one text per query, for DuckDB over the test tables.

Written on their own, not derived from the Spark side: only the stand-in views, the test thresholds
and the lists of one-hot values are shared.
"""

from __future__ import annotations

from . import fixtures as fx

# Digits that doubles are rounded to, filled in per query.
DIGITS = "@D"

YIDONG = "'139','138','137','159','151','158','150','136','187','182'"
LIANTONG = "'130','132','131','186'"
DIANXIN = "'189','180','133','156','153'"


def _secs(t):
    return f"((({t} // 1000000) * 24 + ({t} // 10000) % 100) * 60 + ({t} // 100) % 100) * 60 + {t} % 100"


def _operator(head, foreign):
    return (
        f"case when {head} in ({YIDONG}) then 'yidong' when {head} in ({LIANTONG}) then 'liantong' "
        f"when {head} in ({DIANXIN}) then 'dianxin' {foreign} else 'other' end"
    )


_NAMES = {"events": "events", "lineitem": "lineitem", "customer": "customer"}
VIEWS = {
    "voice": fx.VOICE.format(**_NAMES),
    "sms": fx.SMS.format(**_NAMES),
    "wa": fx.WEB.format(**_NAMES),
    "roster": fx.ROSTER.format(**_NAMES),
    "v": f"""select *, cast({_secs('tel_end_time')} - ({_secs('tel_start_time')}) as bigint) as len,
        cast(tel_start_time // 1000000 as int) as dt, cast((tel_start_time // 10000) % 100 as int) as hr,
        tel_in_and_out as io, {_operator('tel_opp_head', '')} as op from voice""",
    "s": f"""select *, cast(substr(smg_start_time, 1, 2) as int) as dt, cast(substr(smg_start_time, 3, 2) as int) as hr,
        smg_in_and_out as io, {_operator('smg_opp_head', "when smg_opp_head = '000' then 'foreign'")} as op from sms""",
    "w": """select *, visit_dura / nullif(visit_cnt, 0) as per_visit, up_flow + down_flow as flow,
        (down_flow + 1) / (visit_dura + 1) as dl, (up_flow + 1) / (visit_dura + 1) as ul from wa""",
    "known": "select uid, label from roster where label is not null",
}
_NEEDS = {"v": ["voice"], "s": ["sms"], "w": ["wa"], "known": ["roster"]}


def _with(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """The body with the views it uses in front."""
    order: list[str] = []
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in order:
                order.append(name)
    ctes = [f"{name} as ({VIEWS[name]})" for name in order]
    ctes += [f"{name} as ({sql})" for name, sql in (extra or {}).items()]
    return f"with {', '.join(ctes)}\n{body}"


_READ = [
    ("voice", "tel_end_time", "uid tel_opp_num tel_opp_head tel_opp_len tel_start_time tel_end_time tel_call_type tel_in_and_out"),
    ("sms", "cast(smg_start_time as bigint)", "uid smg_opp_num smg_opp_head smg_opp_len smg_start_time smg_in_and_out"),
    ("wa", "down_flow", "uid wa_name visit_cnt visit_dura up_flow down_flow wa_type wa_date"),
]


# ---- pieces ------------------------------------------------------------------------------------


def _agg(stat, value, where=None):
    """One statistic, 0 for an empty slice."""
    tail = f" filter (where {where})" if where else ""
    if stat == "sum":
        return f"cast(coalesce(sum({value}){tail}, 0) as bigint)"
    if stat == "dsum":
        return f"round(coalesce(sum({value}){tail}, 0), @D)"
    if stat in ("max", "min"):
        return f"coalesce({stat}({value}){tail}, 0)"
    if stat in ("dmax", "dmin"):
        return f"round(coalesce({stat[1:]}({value}){tail}, 0), @D)"
    fn = {"mean": "avg", "std": "stddev_samp", "median": "median"}[stat]
    return f"round(coalesce({fn}({value}){tail}, 0), @D)"


def _stats(value, prefixes, stats, double=False):
    """``{prefix: condition}`` x statistics as select items."""
    items = []
    for prefix, where in prefixes.items():
        for stat in stats:
            kind = "d" + stat if double and stat in ("sum", "max", "min") else stat
            items.append(f"{_agg(kind, value, where)} as {prefix}{stat}")
    return items


def _counts(conditions):
    return [f"count(*) filter (where {c}) as {n}" for n, c in conditions.items()]


def _per_user(view, items):
    return f"select uid, {', '.join(items)} from {view} group by uid"


def _long(view, value, name, slices, where="true"):
    """Counts per user and value, one block per slice."""
    blocks = [
        f"select uid, '{s}' as slice, cast({value} as varchar) as {name}, count(*) as n from {view} "
        f"where {value} is not null and {where} and {c} group by uid, {value}"
        for s, c in slices.items()
    ]
    return " union all ".join(blocks)


WAYS = {"all": "true", "in": "io = 1", "out": "io = 0"}
HOURS = ["hr <= 8", "hr > 8 and hr <= 12", "hr > 12 and hr <= 14", "hr > 14 and hr <= 17", "hr >= 17"]


def _lengths(column):
    return {
        "less_5": f"{column} <= 5",
        "less_11": f"{column} between 6 and 10",
        "equal_11": f"{column} = 11",
        "over_11": f"{column} >= 12",
    }


def _bags(column):
    return [f"({column} - 1) // 5 = {b}" for b in range(9)]


def _two_level(view, day, inner, outer, derived=()):
    """Per user and day, then per user; ``derived`` over the finished columns."""
    level1 = f"select uid, {day}, {', '.join(inner)} from {view} group by uid, {day}"
    level2 = f"select uid, {', '.join(outer)} from ({level1}) group by uid"
    if not derived:
        return level2
    return f"select *, {', '.join(derived)} from ({level2})"


def _daily_io(prefixes, stats):
    inner = [
        "count(*) as n_all",
        "nullif(count(*) filter (where io = 1), 0) as n_in",
        "nullif(count(*) filter (where io = 0), 0) as n_out",
    ]
    outer = []
    for prefix, column in prefixes.items():
        for stat in stats:
            if stat == "count":
                outer.append(f"count({column}) as {prefix}count")
            else:
                outer.append(f"{_agg(stat, column)} as {prefix}{stat}")
    return inner, outer


def _daily_diff(prefix):
    """In minus out, from unrounded values."""
    inner, _ = _daily_io({}, [])
    sql = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "count": "count"}
    outer = []
    for stat, fn in sql.items():
        diff = f"coalesce({fn}(n_in), 0) - coalesce({fn}(n_out), 0)"
        diff = f"cast({diff} as bigint)" if stat in ("sum", "count") else f"round({diff}, @D)"
        outer.append(f"{diff} as {prefix}in_out_diff_{stat}")
    return inner, outer


def _daily_counts(view, base, base_in, base_out, diff_prefix):
    inner, outer = _daily_io(
        {base: "n_all", base_in: "n_in", base_out: "n_out"}, ["mean", "count", "sum", "std"]
    )
    return _two_level(view, "dt", inner, outer + _daily_diff(diff_prefix)[1])


# ---- voice -------------------------------------------------------------------------------------

V = {}
V["voice_in_out"] = """select uid, tel_in, tel_out, tel_in + tel_out as tel_fre,
    round((tel_out + 1) / (tel_in + 1), @D) as tel_in_out_ratio
    from (select uid, count(*) filter (where io = 1) as tel_in, count(*) filter (where io = 0) as tel_out
          from v group by uid)"""
V["voice_call_type_counts"] = _long("v", "tel_call_type", "tel_call_type", WAYS)
for _name, _fn in {"mean": "avg", "sum": "sum", "max": "max"}.items():
    _in = f"coalesce({_fn}(len) filter (where io = 1), 0)"
    _out = f"coalesce({_fn}(len) filter (where io = 0), 0)"
    _wrap = "round({}, @D)" if _name == "mean" else "cast({} as bigint)"
    V[f"voice_len_{_name}"] = _per_user(
        "v",
        [
            f"{_wrap.format(_in)} as tel_in_{_name}",
            f"{_wrap.format(_out)} as tel_out_{_name}",
            f"{_wrap.format(f'{_in} - {_out}')} as in_out_{_name}_diff",
        ],
    )
V["voice_len_class_counts"] = _per_user(
    "v",
    _counts(
        {
            "tel_short_fre": "len <= 120",
            "tel_mid_fre": "len between 121 and 600",
            "tel_long_fre": "len >= 601",
        }
    ),
)
V["voice_opp_len_class_counts"] = _per_user(
    "v", _counts({f"tel_opp_{n}": c for n, c in _lengths("tel_opp_len").items()})
)
V["voice_daily_count_stats"] = _daily_counts("v", "tel_date_", "tel_in_date_", "tel_out_date_", "tel_date_")
V["voice_bag_counts"] = _per_user(
    "v", _counts({f"tel_date_cnt_cat_{b}_count": c for b, c in enumerate(_bags("dt"))})
)
V["voice_day_counts"] = _long("v", "dt", "tel_date", WAYS)
V["voice_head_counts"] = _long("v", "tel_opp_head", "tel_opp_head", WAYS)
V["voice_short_number_counts"] = _long("v", "tel_opp_num", "tel_opp_num", {"all": "true"}, "tel_opp_len <= 5")
V["voice_hot_number_counts"] = f"""select uid, value_group, count(*) as n from (
    select uid, case when tel_opp_num in (select tel_opp_num from v group by tel_opp_num having count(*) > {fx.VOICE_HOT})
                     then tel_opp_num else 'other' end as value_group from v) group by uid, value_group"""
V["voice_opp_len_counts"] = _long("v", "tel_opp_len", "tel_opp_len", WAYS)
V["voice_hour_class_counts"] = _per_user(
    "v",
    _counts(
        {
            f"{p}hour_div_{k}": f"({h}) and {c}"
            for p, c in {"tel_": "true", "tel_in_": "io = 1", "tel_out_": "io = 0"}.items()
            for k, h in enumerate(HOURS)
        }
    ),
)
V["voice_distinct"] = """select uid, count(distinct tel_opp_num) + max(case when tel_opp_num is null then 1 else 0 end)
        as voice_opp_num_unique_count,
    count(distinct tel_opp_head) + max(case when tel_opp_head is null then 1 else 0 end) as voice_opp_head_unique_count
    from v group by uid"""
V["voice_len_stats"] = _per_user(
    "v",
    _stats(
        "len",
        {"tel_len_": None, "tel_len_in_": "io = 1", "tel_len_out_": "io = 0"},
        ["std", "max", "min", "median", "mean", "sum"],
    ),
)
V["voice_daily_len_stats"] = _two_level(
    "v",
    "dt",
    ["cast(sum(len) as bigint) as day_len"],
    _stats("day_len", {"tel_len_date_": None}, ["std", "max", "min", "median", "mean", "sum"]),
)
V["voice_operator_len_stats"] = _per_user(
    "v",
    _stats(
        "len",
        {f"{o}_tel_len_": f"op = '{o}'" for o in ["yidong", "liantong", "dianxin", "other"]},
        ["std", "sum", "max", "mean"],
    ),
)
V["voice_operator_counts"] = _per_user(
    "v", _counts({f"{o}_fre": f"op = '{o}'" for o in ["yidong", "liantong", "dianxin"]})
)


def _one_hot(view, value, values, columns, number=False):
    """Wide counts for fixed values: ``{slice condition: name with {}}``."""
    items = []
    for x in values:
        literal = x if number else f"'{x}'"
        for condition, name in columns.items():
            items.append(f'count(*) filter (where {value} = {literal} and {condition}) as "{name.format(x)}"')
    return _per_user(view, items)


_VM = fx.MANIFESTS["voice"]
VOICE_ONE_HOT = [
    _one_hot(
        "v",
        "tel_call_type",
        _VM["type"],
        {"true": "tel_type_{}_fre", "io = 1": "tel_type_{}_fre_in", "io = 0": "tel_type_{}_fre_out"},
        True,
    ),
    _one_hot(
        "v", "dt", _VM["day"], {"true": "tel_date_{}", "io = 1": "tel_in_date_{}", "io = 0": "tel_out_date_{}"}, True
    ),
    _one_hot(
        "v",
        "tel_opp_head",
        _VM["head"],
        {"true": "tel_opp_head_cat_{}", "io = 1": "tel_in_opp_head_cat_{}", "io = 0": "tel_out_opp_head_cat_{}"},
    ),
    _one_hot(
        "v",
        "tel_opp_len",
        _VM["len"],
        {"true": "tel_opp_len_{}", "io = 1": "tel_in_opp_len_{}", "io = 0": "tel_out_opp_len_{}"},
        True,
    ),
    _one_hot("v", "tel_opp_num", _VM["short"], {"tel_opp_len <= 5": "tel_opp_num_{}"}),
]


def _side_by_side(bodies):
    """Parts that all have every user of the table, next to each other."""
    joined = " ".join(
        f"(({body}) p{i})" if i == 0 else f"join ({body}) p{i} using (uid)" for i, body in enumerate(bodies)
    )
    return f"select * from {joined}"


_VOICE_GROUPS = [
    "voice_in_out",
    "voice_len_mean",
    "voice_len_sum",
    "voice_len_max",
    "voice_len_class_counts",
    "voice_opp_len_class_counts",
    "voice_daily_count_stats",
    "voice_bag_counts",
    "voice_hour_class_counts",
    "voice_distinct",
    "voice_len_stats",
    "voice_daily_len_stats",
    "voice_operator_len_stats",
    "voice_operator_counts",
]

# ---- SMS ---------------------------------------------------------------------------------------

S = {}
S["sms_daily_count_stats"] = _daily_counts("s", "msg_date_", "msg_in_date_", "msg_out_date_", "msg_date_")
S["sms_bag_counts"] = _per_user(
    "s", _counts({f"msg_date_cnt_cat_{b}_count": c for b, c in enumerate(_bags("dt"))})
)
S["sms_day_counts"] = _long("s", "dt", "smg_date", WAYS)
S["sms_head_counts"] = _long("s", "smg_opp_head", "smg_opp_head", WAYS)
_OPS = ["yidong", "liantong", "dianxin", "other"]
S["sms_operator_counts"] = _per_user(
    "s",
    _counts(
        {
            f"{o}_msg_{w}count": f"op = '{o}' and {c}"
            for w, c in {"": "true", "in_": "io = 1", "out_": "io = 0"}.items()
            for o in _OPS
        }
    ),
)
S["sms_operator_in_out_diff"] = _per_user(
    "s",
    [
        f"coalesce(nullif(count(*) filter (where op = '{o}' and io = 1), 0) "
        f"- nullif(count(*) filter (where op = '{o}' and io = 0), 0), 0) as {o}_smg_diff_cnt"
        for o in _OPS
    ],
)
S["sms_hot_number_counts"] = f"""select uid, value_group, count(*) as n from (
    select uid, case when smg_opp_num in (select smg_opp_num from s group by smg_opp_num
                     having count(*) > {fx.SMS_BAND[0]} and count(*) < {fx.SMS_BAND[1]})
                     then smg_opp_num else 'other' end as value_group from s) group by uid, value_group"""
S["sms_short_number_counts"] = _long("s", "smg_opp_num", "smg_opp_num", {"all": "true"}, "smg_opp_len <= 7")


def _unique(column, where="true"):
    """Different values, a missing one included."""
    return (
        f"(count(distinct {column}) filter (where {where}) "
        f"+ coalesce(max(case when {column} is null and {where} then 1 end), 0))"
    )


S["sms_opp_len_class"] = _per_user(
    "s",
    [f"{_unique('smg_opp_num')} as smg_opp_unique_count", "count(smg_opp_num) as smg_opp_count"]
    + [
        item
        for n, c in _lengths("smg_opp_len").items()
        for item in (
            f"{_unique('smg_opp_num', c)} as smg_opp_{n}_unique_count",
            f"count(smg_opp_num) filter (where {c}) as smg_opp_{n}_count",
        )
    ],
)
S["sms_opp_len_class_ratio"] = "select uid, {} from ({})".format(
    ", ".join(
        f"round(smg_opp_{n}_{full} / smg_opp_{full}, @D) as smg_opp_{n}_{short}_ratio"
        for n in _lengths("x")
        for short, full in {"unique": "unique_count", "cnt": "count"}.items()
    ),
    S["sms_opp_len_class"],
)
S["sms_in_out"] = """select uid, smg_in_cnt, smg_out_cnt, smg_in_cnt - smg_out_cnt as smg_in_out_cnt_diff from (
    select uid, count(*) filter (where io = 1) as smg_in_cnt, count(*) filter (where io = 0) as smg_out_cnt
    from s group by uid)"""
S["sms_foreign"] = _per_user("s", _counts({"foreign_fre": "smg_opp_head = '000'"}))
S["sms_hour_class_counts"] = _per_user(
    "s",
    _counts(
        {
            f"{p}hour_div_{k}": f"({h}) and {c}"
            for p, c in {"msg_": "true", "msg_in_": "io = 1", "msg_out_": "io = 0"}.items()
            for k, h in enumerate(HOURS)
        }
    ),
)
S["sms_hour_counts"] = _long("s", "hr", "smg_hour", {"all": "true"})
S["sms_opp_len_counts"] = _long("s", "smg_opp_len", "smg_opp_len", WAYS)


def _unique_diff(column):
    seen = [f"nullif({_unique(column, c)}, 0)" for c in ("io = 1", "io = 0")]
    return f"coalesce({seen[0]} - {seen[1]}, 0)"


S["sms_distinct"] = _per_user(
    "s",
    [
        f"{_unique(f'smg_opp_{what}', c)} as smg_{way}opp_{what}_unique"
        for what in ["num", "head"]
        for way, c in {"": "true", "in_": "io = 1", "out_": "io = 0"}.items()
    ]
    + [f"{_unique_diff(f'smg_opp_{what}')} as smg_in_out_opp_{what}_unique_diff" for what in ["num", "head"]],
)
_inner, _outer = _daily_io(
    {"smg_date_": "n_all", "smg_in_date_": "n_in", "smg_out_date_": "n_out"}, ["std", "max", "median"]
)
S["sms_daily_spread"] = _two_level("s", "dt", _inner, _outer)
S["sms_home"] = """select uid, count(*) as smg_fre,
    count(*) - count(*) filter (where smg_opp_head = '000') as home_fre from s group by uid"""

_SM = fx.MANIFESTS["sms"]
SMS_ONE_HOT = [
    _one_hot(
        "s", "dt", _SM["day"], {"true": "msg_date_{}", "io = 1": "msg_in_date_{}", "io = 0": "msg_out_date_{}"}, True
    ),
    _one_hot(
        "s",
        "smg_opp_head",
        _SM["head"],
        {"true": "smg_opp_head_{}", "io = 1": "msg_in_opp_head_cat_{}", "io = 0": "msg_out_opp_head_cat_{}"},
    ),
    _one_hot(
        "s",
        "smg_opp_len",
        _SM["len"],
        {"true": "msg_opp_len_{}", "io = 1": "msg_in_opp_len_{}", "io = 0": "msg_out_opp_len_{}"},
        True,
    ),
    _one_hot("s", "smg_opp_num", _SM["short"], {"smg_opp_len <= 7": "smg_opp_num_{}"}),
]
_SMS_GROUPS = [
    "sms_daily_count_stats",
    "sms_bag_counts",
    "sms_operator_counts",
    "sms_operator_in_out_diff",
    "sms_opp_len_class",
    "sms_opp_len_class_ratio",
    "sms_in_out",
    "sms_foreign",
    "sms_distinct",
    "sms_daily_spread",
    "sms_home",
]

# ---- web and apps ------------------------------------------------------------------------------

W = {}
W["wa_distinct_names"] = _per_user(
    "w",
    [
        f"{_unique('wa_name', c)} as wa_name_{t}unique_count"
        for t, c in {"": "true", "web_": "wa_type = 0", "app_": "wa_type = 1"}.items()
    ],
)
_SKEWED = f"""select wa_name, bad_times, good_times, bad_times / p as bad_ratio, good_times / q as good_ratio,
        bad_times / p - good_times / q as diff
    from (select wa_name, count(distinct uid) filter (where label = 1) as bad_times,
                 count(distinct uid) filter (where label = 0) as good_times
          from wa join known using (uid) where wa_name is not null group by wa_name),
         (select count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as q from known)
    where bad_times >= {fx.MIN_BAD} and good_times <= {fx.MAX_GOOD}"""
W["wa_skewed_names"] = f"""select wa_name, bad_times, good_times, round(bad_ratio, @D) as bad_ratio,
    round(good_ratio, @D) as good_ratio, round(diff, @D) as diff from ({_SKEWED}) order by diff desc, wa_name"""
W["wa_skewed_name_counts"] = f"""select uid, wa_name, count(*) as n from wa
    where wa_name in (select wa_name from ({_SKEWED})) group by uid, wa_name"""
W["wa_hot_name_counts"] = f"""select uid, wa_name, count(*) as n from w
    where wa_name in (select wa_name from w group by wa_name having count(*) > {fx.WEB_HOT}) group by uid, wa_name"""


def _shares(total, part, prefix, suffix):
    return _per_user(
        "w",
        [
            f"round(coalesce({part.format(c)} / nullif({total}, 0), 0), @D) as {prefix}{b}_{suffix}"
            for b, c in enumerate(_bags("wa_date"))
        ],
    )


W["wa_bag_flow_share"] = _shares(
    "sum(down_flow)", "sum(down_flow) filter (where {})", "wa_date_cat_flow_", "sum"
)
W["wa_bag_count_share"] = _shares("count(*)", "count(*) filter (where {})", "wa_date_cat_", "count")
W["wa_bag_dura_share"] = _shares(
    "sum(visit_dura)", "sum(visit_dura) filter (where {})", "wa_date_cat_dura_", "sum"
)
W["wa_row_counts"] = """select *, wa_web_count - wa_app_count as wa_cnt_diff from (
    select uid, count(wa_name) as wa_count, count(wa_name) filter (where wa_type = 0) as wa_web_count,
        count(wa_name) filter (where wa_type = 1) as wa_app_count from w group by uid)"""
_WEB_STATS = ["std", "max", "median", "mean", "sum"]


def _web_daily(value, prefixes, diff_name, diff):
    inner = [
        f"cast(sum({value}) as bigint) as d_all",
        f"cast(sum({value}) filter (where wa_type = 0) as bigint) as d_web",
        f"cast(sum({value}) filter (where wa_type = 1) as bigint) as d_app",
    ]
    outer = []
    for prefix, column in zip(prefixes, ["d_all", "d_web", "d_app"]):
        outer += _stats(column, {prefix: None}, ["sum", "std", "max", "mean", "median"])
    return _two_level("w", "wa_date", inner, outer, [f"{diff} as {diff_name}"])


W["wa_daily_visit_stats"] = _web_daily(
    "visit_cnt",
    ["wa_visit_cnt_date_", "wa_web_visit_cnt_date_", "wa_app_visit_cnt_date_"],
    "wa_visit_cnt_date_diff",
    "wa_web_visit_cnt_date_sum - wa_app_visit_cnt_date_sum",
)


def _by_type(what):
    return {f"wa_{what}_": None, f"wa_web_{what}_": "wa_type = 0", f"wa_app_{what}_": "wa_type = 1"}


W["wa_visit_stats"] = "select *, wa_web_visit_cnt_sum - wa_app_visit_cnt_sum as wa_visit_cnt_diff from ({})".format(
    _per_user("w", _stats("visit_cnt", _by_type("visit_cnt"), _WEB_STATS))
)
W["wa_daily_dura_stats"] = _web_daily(
    "visit_dura",
    ["wa_visit_dura_date_", "wa_visit_web_dura_date_", "wa_visit_app_dura_date_"],
    "wa_visit_dura_date_diff",
    "wa_visit_web_dura_date_sum - wa_visit_app_dura_date_sum",
)
W["wa_dura_decade_counts"] = _per_user(
    "w",
    _counts(
        {
            "wa_visit_dura_cat_0": "visit_dura < 10",
            **{f"wa_visit_dura_cat_{k}": f"visit_dura >= {10**k} and visit_dura < {10 ** (k + 1)}" for k in range(1, 7)},
            "wa_visit_dura_cat_7": "visit_dura >= 10000000",
        }
    ),
)
W["wa_up_flow_stats"] = _per_user("w", _stats("up_flow", _by_type("up_flow"), _WEB_STATS))
W["wa_down_flow_stats"] = _per_user("w", _stats("down_flow", _by_type("down_flow"), _WEB_STATS))
W["wa_flow_amount_stats"] = _per_user("w", _stats("flow", _by_type("amount_flow"), _WEB_STATS))
W["wa_active_days"] = "select uid, count(distinct wa_date) as wa_active_days from w group by uid"
W["wa_daily_per_visit_stats"] = _two_level(
    "w",
    "wa_date",
    ["sum(per_visit) as d"],
    _stats("d", {"wa_visit_per_dura_": None}, ["sum", "std", "max", "mean", "median"], double=True),
)
W["wa_speed_stats"] = _per_user(
    "w",
    _stats("dl", {"download_speed_": None}, _WEB_STATS, double=True)
    + _stats("ul", {"upload_speed_": None}, _WEB_STATS, double=True)
    + _stats("dl + ul", {"amount_speed_": None}, _WEB_STATS, double=True),
)
_WM = fx.MANIFESTS["wa"]
WEB_ONE_HOT = [
    _one_hot("w", "wa_name", _WM["bad"], {"true": "bad_wa_names_{}_cnt"}),
    _one_hot("w", "wa_name", _WM["hot"], {"true": "hot_wa_names_{}_cnt"}),
]
_WEB_GROUPS = [
    "wa_distinct_names",
    "wa_bag_flow_share",
    "wa_bag_count_share",
    "wa_bag_dura_share",
    "wa_row_counts",
    "wa_daily_visit_stats",
    "wa_visit_stats",
    "wa_daily_dura_stats",
    "wa_dura_decade_counts",
    "wa_up_flow_stats",
    "wa_down_flow_stats",
    "wa_flow_amount_stats",
    "wa_active_days",
    "wa_daily_per_visit_stats",
    "wa_speed_stats",
]

# ---- wide tables -------------------------------------------------------------------------------

VOICE_MATRIX = _side_by_side([V[g] for g in _VOICE_GROUPS] + VOICE_ONE_HOT)
SMS_MATRIX = _side_by_side([S[g] for g in _SMS_GROUPS] + SMS_ONE_HOT)
WEB_MATRIX = _side_by_side([W[g] for g in _WEB_GROUPS] + WEB_ONE_HOT)
_MATRICES = {"vm": VOICE_MATRIX, "sm": SMS_MATRIX, "wm": WEB_MATRIX}


def _filled(source, kept):
    return f"select {kept}, coalesce(columns(* exclude ({kept})), 0) from ({source})"


def _for_users(users, kept):
    source = (
        f"select * from ({users}) left join vm using (uid) left join sm using (uid) left join wm using (uid)"
    )
    return _filled(source, kept)


# ---- rows, joins, scores -----------------------------------------------------------------------

_VOICE_COLUMNS = "uid, tel_opp_num, tel_opp_head, tel_opp_len, tel_start_time, tel_end_time, tel_call_type, tel_in_and_out"
_HASH = "cast('0x' || substr(md5(uid || ':42'), 1, 8) as bigint) % 100 < 25"

SCORES = " union all ".join(
    f"select uid, '{f}' as family, {s} as seed, avg(case when "
    + (f"(tel_opp_len + {s}) % 5 < 2" if f == "deep" else f"(hr + {s}) % 4 < 2")
    + " then 1e0 else 0e0 end) as score from v group by uid"
    for f, seeds in {"deep": [0, 7, 14], "shallow": [0, 1, 2]}.items()
    for s in seeds
)
AVERAGED = "select uid, family, avg(score) as score from scores group by uid, family"
BLENDED = """select uid, sum(case family when 'deep' then 0.96::double * score else 1.04::double * score end) as blend
    from averaged group by uid"""
LABELLED = "select uid, blend, case when blend >= 0.911::double then 1 else 0 end as label from blended"


def _scored_users(columns: str, *others: str) -> str:
    """Every user without a label, once per row of the other tables."""
    return _with(f"select uid, {columns} from {', '.join(['roster', *others])} where label is null", "roster")


SCORED = "select uid, label, round(score, 9) as score from averaged join known using (uid) where family = 'deep'"
_CHAIN = {"scores": SCORES, "averaged": AVERAGED, "blended": BLENDED, "labelled": LABELLED}

AUC = """(select sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end)
         / nullif(count(*), 0) from scored a, scored b where a.label = 1 and b.label = 0)"""
F1 = """(select coalesce(2 * count(*) filter (where score >= 0.3 and label = 1)
         / nullif(2 * count(*) filter (where score >= 0.3 and label = 1)
                  + count(*) filter (where score >= 0.3 and label = 0)
                  + count(*) filter (where score < 0.3 and label = 1), 0), 0) from scored)"""


def _scored(body):
    return _with(body, "v", "known", extra={"scores": SCORES, "averaged": AVERAGED, "scored": SCORED})


def _chain(body):
    return _with(body, "v", "known", extra=_CHAIN)


def _class_case(conditions):
    return "case " + " ".join(f"when {c} then '{n}'" for n, c in conditions.items()) + " end"


# One-hot values picked from the data: (source, dim) -> view, value, condition, slices.
_ONE_HOT = {
    ("voice", "type"): ("v", "tel_call_type", "true", WAYS),
    ("voice", "day"): ("v", "dt", "true", WAYS),
    ("voice", "head"): ("v", "tel_opp_head", "true", WAYS),
    ("voice", "len"): ("v", "tel_opp_len", "true", WAYS),
    ("voice", "short"): ("v", "tel_opp_num", "tel_opp_len <= 5", {"all": "true"}),
    ("sms", "day"): ("s", "dt", "true", WAYS),
    ("sms", "head"): ("s", "smg_opp_head", "true", WAYS),
    ("sms", "len"): ("s", "smg_opp_len", "true", WAYS),
    ("sms", "short"): ("s", "smg_opp_num", "smg_opp_len <= 7", {"all": "true"}),
    ("wa", "bad"): ("wa", "wa_name", f"wa_name in (select wa_name from ({_SKEWED}))", {"all": "true"}),
    ("wa", "hot"): (
        "wa",
        "wa_name",
        f"wa_name in (select wa_name from wa group by wa_name having count(*) > {fx.WEB_HOT})",
        {"all": "true"},
    ),
}
_PICKED = " union all ".join(
    f"select distinct '{source}' as source, '{dim}' as dim, cast({value} as varchar) as key from {view} "
    f"where {value} is not null and {where}"
    for (source, dim), (view, value, where, _) in _ONE_HOT.items()
)
_CELLS = "select c.* from (" + " union all ".join(
    f"select '{source}' as source, '{dim}' as dim, uid, slice, key, n from ({_long(view, value, 'key', slices, where)})"
    for (source, dim), (view, value, where, slices) in _ONE_HOT.items()
) + ") c semi join picked using (source, dim, key)"

# The fitted space: numeric features in the order of their names, then one slot per value and slice.
_ALL_GROUPS = {"vn": [V[g] for g in _VOICE_GROUPS], "sn": [S[g] for g in _SMS_GROUPS], "wn": [W[g] for g in _WEB_GROUPS]}
_NUMERIC = {
    **{name: _side_by_side(groups).replace("@D", "12") for name, groups in _ALL_GROUPS.items()},
    "numeric": "select uid, label, cast(coalesce(columns(* exclude (uid, label)), 0) as double) from (select uid, label from roster) "
    "left join vn using (uid) left join sn using (uid) left join wn using (uid)",
    "entries": "select * from (unpivot numeric on columns(* exclude (uid, label)) into name key value value)",
}
_ONE_HOT_SLICES = " union all ".join(
    f"select '{source}' as source, '{dim}' as dim, '{slice_}' as slice"
    for (source, dim), (_, _, _, slices) in _ONE_HOT.items()
    for slice_ in slices
)
_SLOTS = {
    "picked": _PICKED,
    "slices": _ONE_HOT_SLICES,
    "names": "select key, row_number() over (order by key) - 1 as slot from (select distinct key from entries)",
    "hots": """select source, dim, key, slice, (select count(*) from names) - 1
        + row_number() over (order by source, dim, key, slice) as slot from picked join slices using (source, dim)""",
    "slots": "select slot, 'all' as source, 'numeric' as dim, key, 'all' as slice from names union all "
    "select slot, source, dim, key, slice from hots",
}

ROWS = {
    "read_voice": _with("select * from voice", "voice"),
    "read_sms": _with("select * from sms", "sms"),
    "read_wa": _with("select * from wa", "wa"),
    "read_faults": _with(
        "\nunion all ".join(
            f"""select '{source}' as source, '{c}' as "column", count(*) as read,
            count(*) filter (where {number} % 10 in (3, 4, 5)) as malformed,
            count(*) filter (where {number} % 10 not in (3, 4, 5) and {c} is null) as missing from {source}"""
            for source, number, columns in _READ
            for c in columns.split()
        ),
        "voice",
        "sms",
        "wa",
    ),
    "read_labels": _with("select uid, label from known", "known"),
    "test_roster": _with(
        "select 'u' || cast(range as varchar) as uid from range(5000, 5000 + (select count(*) from roster))", "roster"
    ),
    "read_predictions": _with("select uid, label from known", "known"),
    "write_submission": _chain("select uid, label from labelled"),
    "union_rounds": _with(f"select {_VOICE_COLUMNS} from voice", "voice"),
    "union_pseudo_labels": _chain(
        "select uid, label from known union all "
        "select uid, label from labelled where uid not in (select uid from known)"
    ),
    "call_duration": _with("select uid, tel_start_time, tel_end_time, len as tel_len from v", "v"),
    "call_day_hour": _with("select uid, tel_start_time, dt as tel_date, hr as tel_hour from v", "v"),
    "sms_day_hour": _with("select uid, smg_start_time, dt as smg_date, hr as smg_hour from s", "s"),
    "day_bag": _with(
        """select source, uid, day, (day - 1) // 5 as bag from (select 'voice' as source, uid, dt as day from v
        union all select 'sms', uid, dt from s union all select 'wa', uid, wa_date from wa) where (day - 1) // 5 < 9""",
        "v",
        "s",
        "wa",
    ),
    "number_length_class": _with(
        f"""select source, uid, opp_len, {_class_case(_lengths('opp_len'))} as cls from (select 'voice' as source, uid,
        tel_opp_len as opp_len from voice union all select 'sms', uid, smg_opp_len from sms)""",
        "voice",
        "sms",
    ),
    "hour_class": _with(
        "select source, uid, hr as hour, "
        + ", ".join(f"cast(({h}) as int) as class_{k}" for k, h in enumerate(HOURS))
        + " from (select 'voice' as source, uid, hr from v union all select 'sms', uid, hr from s)",
        "v",
        "s",
    ),
    "call_length_class": _with(
        """select uid, len as tel_len, case when len <= 120 then 'short' when len <= 600 then 'mid' else 'long' end
        as cls from v""",
        "v",
    ),
    "duration_decade": _with(
        "select uid, visit_dura, case when visit_dura < 10 then 0 else least(len(cast(visit_dura as varchar)) - 1, 7) "
        "end as decade from wa",
        "wa",
    ),
    "operator_class": _with(
        "select 'voice' as source, uid, tel_opp_head as head, op as operator from v union all "
        "select 'sms', uid, smg_opp_head, op from s",
        "v",
        "s",
    ),
    "wa_rates": _with(
        """select uid, wa_date, round(per_visit, @D) as visit_per_dura, flow as flow_amount,
        round(dl, @D) as download_speed, round(ul, @D) as upload_speed, round(dl + ul, @D) as amount_speed from w""",
        "w",
    ),
    "slice_rows": _with(
        """select * from (select 'voice' as source, uid, tel_in_and_out as slice, tel_opp_num as name,
            cast(tel_start_time as bigint) as moment from voice
        union all select 'sms', uid, smg_in_and_out, smg_opp_num, cast(smg_start_time as bigint) from sms
        union all select 'wa', uid, wa_type, wa_name, cast(wa_date as bigint) from wa) where slice in (0, 1)""",
        "voice",
        "sms",
        "wa",
    ),
    "truncate_features": _with(
        f"select uid, cast(trunc(columns(* exclude (uid))) as bigint) from ({SMS_MATRIX.replace('@D', '12')})", "s"
    ),
    "feature_manifest": _with("select * from picked", "v", "s", "wa", "known", extra={"picked": _PICKED}),
    "feature_cells": _with(_CELLS, "v", "s", "wa", "known", extra={"picked": _PICKED}),
    "feature_slots": _with("select slot, source, dim, key, slice from slots", "v", "s", "w", "known", extra={**_NUMERIC, **_SLOTS}),
    "feature_slot_values": _with(
        f"""select uid, label, cast(slot as int) as slot, value from (
        select uid, label, slot, case when abs(value) < 1000 then round(value, 6) else round(value, 3) end as value
        from (select uid, label, slot, value from entries join names using (key) union all
              select r.uid, r.label, slot, n from roster r join ({_CELLS}) using (uid) join hots using (source, dim, key, slice))
        ) where value <> 0""",
        "v",
        "s",
        "w",
        "known",
        extra={**_NUMERIC, **_SLOTS},
    ),
    "domain_outer": _with(
        _filled("select * from vm full join sm using (uid) full join wm using (uid)", "uid"),
        "v",
        "s",
        "w",
        extra=_MATRICES,
    ),
    "train_matrix": _with(
        _for_users("select uid, label from known", "uid, label"), "v", "s", "w", "known", extra=_MATRICES
    ),
    "score_matrix": _with(
        _for_users("select uid from roster where label is null", "uid"), "v", "s", "w", "roster", extra=_MATRICES
    ),
    "full_feature_matrix": _with(
        _for_users("select uid, label from roster", "uid, label"), "v", "s", "w", "roster", extra=_MATRICES
    ),
    "hot_value_split": _with(
        f"""select uid, tel_opp_num, tel_start_time, case when tel_opp_num in (
        select tel_opp_num from voice group by tel_opp_num having count(*) > {fx.VOICE_HOT})
        then tel_opp_num else 'other' end as value_group from voice""",
        "voice",
    ),
    "feature_group_outer": _with(_side_by_side([V[g] for g in _VOICE_GROUPS]), "v"),
    "voice_feature_matrix": _with(VOICE_MATRIX, "v"),
    "sms_feature_matrix": _with(SMS_MATRIX, "s"),
    "wa_feature_matrix": _with(WEB_MATRIX, "w"),
    "holdout_split": _with(f"select uid, label, case when {_HASH} then 1 else 0 end as held from known", "known"),
    "gbt_deep_scored_users": _scored_users("'deep' as family, seed, 1 as in_range", "(values (0), (7)) as s(seed)"),
    "gbt_shallow_scored_users": _scored_users("'shallow' as family, seed, 1 as in_range", "(values (0), (1)) as s(seed)"),
    "mlp_scored_users": _scored_users("1 as adds_up"),
    "gbt_regression_scored_users": _scored_users("1 as adds_up"),
    "seed_average": _chain("select uid, family, round(score, @D) as score from averaged"),
    "weighted_blend": _chain("select uid, round(blend, @D) as blend from blended"),
    "threshold_label": _chain("select uid, round(blend, @D) as blend, label from labelled"),
    "rank_submission": _chain(
        "select uid, blend, label, row_number() over (order by blend desc, uid) as rank from "
        "(select uid, round(blend, 6) as blend, label from labelled)"
    ),
    "auc": _scored(f"select round({AUC}, @D) as auc"),
    "f1_at": _scored(f"select round({F1}, @D) as f1"),
    "combined_score": _scored(
        f"select round(auc, @D) as auc, round(f1, @D) as f1, round(0.6::double * auc + 0.4::double * f1, @D) as res "
        f"from (select {AUC} as auc, {F1} as f1)"
    ),
}

# Queries whose doubles carry three digits: the same as on the Spark side.
THREE_DIGITS = {
    "domain_outer",
    "train_matrix",
    "score_matrix",
    "full_feature_matrix",
    "feature_group_outer",
    "voice_feature_matrix",
    "sms_feature_matrix",
    "wa_feature_matrix",
    "wa_daily_dura_stats",
    "wa_up_flow_stats",
    "wa_down_flow_stats",
    "wa_flow_amount_stats",
    "wa_daily_per_visit_stats",
    "wa_speed_stats",
}


def oracle_texts() -> dict[str, str]:
    """Every text, with its digits filled in."""
    texts = dict(ROWS)
    texts.update({n: _with(sql, "v") for n, sql in V.items()})
    texts.update({n: _with(sql, "s") for n, sql in S.items()})
    texts.update({n: _with(sql, "w", "known") for n, sql in W.items()})
    # The way that very active users take, with all users on it: the same result.
    texts.update({f"{n}_hot": texts[n] for n in ("voice_len_stats", "wa_visit_stats", "wa_speed_stats")})
    # States of two rounds merged: the same result as over all rows.
    days = ("voice_daily_count_stats", "sms_daily_count_stats", "wa_daily_visit_stats", "wa_daily_dura_stats")
    texts.update({f"{n}_merged": texts[n] for n in days})
    moments = _stats("len", {"tel_len_": None, "tel_len_in_": "io = 1", "tel_len_out_": "io = 0"}, ["std", "max", "min", "mean", "sum"])
    texts["voice_len_moments_merged"] = _with(_per_user("v", moments), "v")
    return {n: sql.replace("@D", "3" if n.removesuffix("_hot").removesuffix("_merged") in THREE_DIGITS else "6") for n, sql in texts.items()}
