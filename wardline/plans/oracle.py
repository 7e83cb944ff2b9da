"""For each named query, the same result as plain SQL over the sample tables."""

from __future__ import annotations

from wardline import fixtures
from wardline.functions import text as X
from wardline.operators import aggregate as A
from wardline.operators import answers, cost_model, overview, profile, quality
from wardline.operators import questions as Q
from wardline.plans import registry as R
from wardline.schema import NAMES, REQUIRED, TEXT_COLUMNS, TYPED

YEAR = R.LAST_YEAR
NAME_LIST = ", ".join(NAMES)


def _hash(columns: list[str]) -> str:
    parts = [f"coalesce(cast({c} as varchar), chr(30))" for c in columns]
    return "sha256(concat_ws(chr(31), " + ", ".join(parts) + "))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


def _int(c: str, dtype: str = "integer") -> str:
    return f"case when regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$') then try_cast(trim({c}) as {dtype}) end"


def _decimal(c: str) -> str:
    return (
        f"case when regexp_matches({c}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)\\s*$') "
        f"then try_cast(trim({c}) as decimal(14,2)) end"
    )


def _double(c: str) -> str:
    return (
        f"case when regexp_matches({c}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') "
        f"then try_cast(trim({c}) as double) end"
    )


def _plain(c: str) -> str:
    return f"replace(replace({c}, ',', ''), '$', '')"


def _blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


def _floor0(e: str) -> str:
    return f"case when ({e}) >= 0 then ({e}) end"


STAY = _floor0(_int("replace(length_of_stay, ' +', '')"))
SEVERITY = f"case when ({_int('apr_severity_of_illness_code', 'smallint')}) between 0 and 255 then ({_int('apr_severity_of_illness_code', 'smallint')}) end"
COSTS = "replace(total_costs, chr(13), '')"
STRICT = {
    "length_of_stay": STAY,
    "discharge_year": _int("discharge_year", "smallint"),
    "apr_severity_of_illness_code": SEVERITY,
    "birth_weight": f"case when type_of_admission = 'Newborn' then {_blank('birth_weight')} end",
    "total_charges": _floor0(_decimal(_plain("total_charges"))),
    "total_costs": _floor0(_decimal(_plain(COSTS))),
}
STRICT = {n: STRICT.get(n, _blank(n)) for n in NAMES}

_TABLES = {t: t for t in (*fixtures.TABLES, "conversations", "events")}
RAW = (
    f"once as materialized ({fixtures.RAW_SELECT.format(**_TABLES)}),\n"
    f"raw as materialized (select {NAME_LIST} from once union all select {NAME_LIST} from once where copies = 2)"
)
FACT = (
    f"{RAW},\nclean as (select {', '.join(f'{e} as {n}' for n, e in STRICT.items())} from raw),\n"
    f"counted as (select {NAME_LIST}, cast(count(*) as bigint) as source_rows from clean group by {NAME_LIST}),\n"
    f"fact as materialized (select *, {_hash(NAMES)} as row_hash from counted)"
)
QUESTIONS = f"questions as materialized ({fixtures.QUESTION_SELECT.format(**_TABLES)})"
LEDGER = f"ledger as ({fixtures.LEDGER_SELECT.format(**_TABLES)})"


def on_raw(sql: str, *ctes: str) -> str:
    return "with " + ",\n".join((RAW, *ctes)) + "\n" + sql


def on_fact(sql: str, *ctes: str) -> str:
    return "with " + ",\n".join((FACT, *ctes)) + "\n" + sql


# ---- group-by analyses ------------------------------------------------------------------------


def _mean(c: str) -> str:
    return f"cast(sum({c}) as double) / cast(nullif(count({c}), 0) as double)"


METRICS = {
    "count": "cast(count(*) as bigint)",
    "avg_length_of_stay": _mean("length_of_stay"),
    "avg_total_charges": _mean("total_charges"),
    "sum_total_charges": "cast(sum(total_charges) as double)",
    "avg_total_costs": _mean("total_costs"),
    "sum_total_costs": "cast(sum(total_costs) as double)",
}
STAY_METRICS = ["count", "avg_length_of_stay", "avg_total_charges"]
COST_METRICS = ["count", "sum_total_charges", "avg_total_charges", "avg_total_costs"]
DEFAULT = ["count", "avg_length_of_stay"]


def _agg(dim: str, metrics=DEFAULT, limit: int = 20, where: str = "true", alias: str = "dimension_value") -> str:
    c = A.DIMENSIONS[dim]
    order = f"{c} asc nulls first" if dim == "year" else f"count(*) desc, {c} asc nulls first"
    columns = ", ".join(f'{METRICS[m]} as "{m}"' for m in metrics)
    return f"select {c} as {alias}, {columns} from fact where {where} group by {c} order by {order} limit {limit}"


PAYMENT = (
    'select payment_typology_1 as payment, cast(count(*) as bigint) as "count", '
    "round(cast(count(*) as double) / (select cast(count(*) as double) from fact), 6) as ratio "
    "from fact group by 1 order by 2 desc, 1 asc nulls first limit 20"
)
TREND = _agg("year", ["count", "avg_total_charges", "avg_length_of_stay"], 50, alias="year")
SUMMARY = (
    "select cast(count(*) as bigint) as discharges, cast(count(distinct nullif(facility_name, '')) as bigint) as facilities, "
    f"{METRICS['avg_length_of_stay']} as avg_length_of_stay, {METRICS['avg_total_charges']} as avg_total_charges, "
    f"{METRICS['sum_total_charges']} as total_charges from fact"
)


def _overview() -> str:
    null_ratio = "cast(null as double)"
    parts = [
        "select 'summary' as section, 0 as rank, cast(null as varchar) as dimension_value, discharges as \"count\", "
        f"avg_length_of_stay, avg_total_charges, {null_ratio} as ratio, facilities, total_charges from ({SUMMARY})"
    ]
    for section, dim, limit in overview.SECTIONS:
        shown = overview.SECTION_METRICS[section]
        metrics = ["count"] + [m for m in shown if m in METRICS]
        value = {m: m if m in shown else "cast(null as double)" for m in ("avg_length_of_stay", "avg_total_charges")}
        ratio = null_ratio
        if "ratio" in shown:
            ratio = 'round(cast("count" as double) / (select cast(count(*) as double) from fact), 6)'
        order = "dimension_value asc nulls first" if dim == "year" else '"count" desc, dimension_value asc nulls first'
        parts.append(
            f"select '{section}', cast(row_number() over (order by {order}) as int), cast(dimension_value as varchar), "
            f"\"count\", {value['avg_length_of_stay']}, {value['avg_total_charges']}, {ratio}, "
            f"cast(null as bigint), cast(null as double) from ({_agg(dim, metrics, limit)})"
        )
    return " union all ".join(parts)


SHARE = 'coalesce(100 * cast("count" as double) / cast(nullif(sum("count") over (), 0) as double), 0.0)'


def _segments() -> str:
    def top(dim: str, limit: int, segment: str) -> str:
        rows = _agg(dim, ["count"], limit)
        return (
            f"select '{segment}' as segment, (select dimension_value from ({rows}) order by \"count\" desc, dimension_value limit 1) as detail, "
            f"max(\"count\") as \"count\", 100 * (cast(max(\"count\") as double) / cast(sum(\"count\") as double)) as percent from ({rows})"
        )

    match = f"regexp_matches(apr_severity_of_illness_desc, '{overview.HIGH_SEVERITY}')"
    high = (
        "select 'high_severity', 'APR Major / Extreme', cast(count(*) filter (where " + match + ") as bigint), "
        "coalesce(100 * (cast(count(*) filter (where " + match + ") as double) / cast(nullif(count(*), 0) as double)), 0.0) from fact"
    )
    return " union all ".join([top("age_group", 10, "top_age"), top("disease", 8, "top_disease"), high])


LABEL = f"coalesce(nullif({{}}, ''), '{overview.UNLABELLED}')"


# ---- quality ----------------------------------------------------------------------------------


def _one(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def _marks() -> dict[str, tuple[str, int]]:
    complete = [_one(f"{c} is not null and {c} <> ''") for c in REQUIRED]
    accurate = [_one(f"({_double(f'''replace({c}, ',', '')''')}) >= 0") for c in quality.NUMBER_FIELDS]
    consistent = [_one(f"coalesce({c}, '') in {_in(v)}") for c, v in quality.VALID_CODES.items()]
    timely = [_one(f"({_double('discharge_year')}) between 2000 and {YEAR}")]
    groups = dict(zip(quality.SCORES, (complete, accurate, consistent, timely)))
    return {n: ("(" + " + ".join(m) + ")", len(m)) for n, m in groups.items()}


def _score(name: str) -> str:
    marks, possible = _marks()[name]
    return f"cast(sum({marks}) as double) / cast(count(*) * {possible} as double)"


RAW_UNIQUE = f"cast(count(distinct {_hash(NAMES)}) as double) / cast(count(*) as double)"
OVERALL = "round((completeness + accuracy + consistency + timeliness) / cast(4 as double), 4) as overall"
ASSESS = (
    f"select *, {OVERALL} from (select "
    + ", ".join(f"round({_score(n)}, 4) as {n}" for n in quality.SCORES)
    + f", round({RAW_UNIQUE}, 4) as uniqueness, cast(count(*) as bigint) as sample_size from raw)"
)
STRICT_RULES = {
    "completeness": "facility_name is not null and age_group is not null and discharge_year is not null "
    "and ccsr_diagnosis_description is not null and payment_typology_1 is not null",
    "accuracy": "length_of_stay >= 0 and total_charges >= 0 and total_costs >= 0",
    "consistency": "gender in ('M','F','U') and emergency_department_indicator in ('Y','N')",
    "timeliness": f"discharge_year between 2000 and {YEAR}",
}


def _strict_score(name: str) -> str:
    return f"cast(sum({_one(STRICT_RULES[name])}) as double) / cast(count(*) as double)"


STRICT_REPORT = (
    f"select *, {OVERALL} from (select "
    + ", ".join(f"round({_strict_score(n)}, 4) as {n}" for n in quality.SCORES)
    + ", round(cast(count(*) as double) / cast(sum(source_rows) as double), 4) as uniqueness, "
    "cast(sum(source_rows) as bigint) as sample_size from fact)"
)
CLEAN_RULES = {
    "negative_charges": "total_charges < 0",
    "negative_costs": "total_costs < 0",
    "invalid_length_of_stay": "length_of_stay is null or length_of_stay < 0",
    "invalid_birth_weight": "birth_weight is not null and not coalesce(try_cast(birth_weight as int) between 1 and 15000, false)",
    "invalid_year": f"not coalesce(discharge_year between 1900 and {YEAR}, false)",
    "invalid_emergency_indicator": "not coalesce(emergency_department_indicator in ('Y','N'), false)",
}


def _cells() -> str:
    cells = " + ".join(f"count({c})" for c in NAMES)
    broken = " + ".join(f"sum({_one(r)})" for r in CLEAN_RULES.values())
    bad_row = " or ".join(f"({CLEAN_RULES[r]})" for r in ("invalid_year", "invalid_emergency_indicator", "invalid_length_of_stay"))
    d = "cast({} as double)".format
    return (
        "select cast(count(*) as bigint) as total_rows, "
        f"round(100 * ({d(f'({cells})')} / {d(f'(count(*) * {len(NAMES)})')}), 2) as completeness_percent, "
        f"round(100 * (1 - {d(f'({broken})')} / {d('(count(*) * 6)')}), 2) as validity_percent, "
        f"round(100 * ({d(f'sum({_one(f'not ({bad_row})')})')} / {d('count(*)')}), 2) as consistency_percent, "
        f"round(100 * ({d('(sum(source_rows) - count(*))')} / {d('sum(source_rows)')}), 4) as duplicate_rate_percent from fact"
    )


# ---- audits -----------------------------------------------------------------------------------


def _profile() -> str:
    parts = []
    for c in NAMES:
        if c in TYPED:
            numbers = (
                f"cast(count({c}) as bigint), cast(min({c}) as double), {_mean(c)}, cast(max({c}) as double), "
                f"round(stddev_samp(cast({c} as double)), 4)"
            )
        else:
            numbers = "cast(null as bigint), cast(null as double), cast(null as double), cast(null as double), cast(null as double)"
        parts.append(
            f"select '{c}', cast(count(*) as bigint), cast(count(*) - count({c}) as bigint), "
            f"cast(count(*) - count({c}) as double) / cast(count(*) as double), cast(count(distinct {c}) as bigint), {numbers} from fact"
        )
    names = 'column_name, "rows", missing, missing_rate, distinct_values, number_count, "min", "mean", "max", "std"'
    return f"select * from ({' union all '.join(parts)}) as p({names})"


def _top_values() -> str:
    unfolded = " union all ".join(
        f"select '{c}' as column_name, cast({c} as varchar) as value from fact" for c in profile.TOP_VALUE_COLUMNS
    )
    return (
        "select * from (select *, cast(row_number() over (partition by column_name order by \"count\" desc, value) as int) as rank from "
        f"(select column_name, value, cast(count(*) as bigint) as \"count\" from ({unfolded}) where value is not null group by 1, 2)) where rank <= 10"
    )


GRAMS = _int("birth_weight")
NEWBORN = "(coalesce(type_of_admission = 'Newborn', false) or coalesce(trim(apr_mdc_code) in ('15'), false))"
WEIGHT = f"case when {NEWBORN} and ({GRAMS}) > 0 and ({GRAMS}) <= 15000 then ({GRAMS}) end"


def _anomalies() -> str:
    def filled(c: str) -> str:
        return f"{_blank(c)} is not null"

    def not_whole(c: str, low: int, high: int) -> str:
        return f"{filled(c)} and not coalesce(({_int(c)}) between {low} and {high}, false)"

    stay = _int("replace(replace(length_of_stay, ' +', ''), '+', '')")
    charges, costs = _decimal(_plain("total_charges")), _decimal(_plain("total_costs"))
    rules = {
        "birth_weight_cleared": f"{filled('birth_weight')} and ({WEIGHT}) is null",
        "invalid_apr_drg_code": not_whole("apr_drg_code", 0, 999),
        "invalid_apr_mdc_code": not_whole("apr_mdc_code", 0, 25),
        "invalid_discharge_year": not_whole("discharge_year", 1900, YEAR),
        "invalid_emergency_indicator": f"{filled('emergency_department_indicator')} and emergency_department_indicator not in ('Y','N')",
        "invalid_facility_id": not_whole("permanent_facility_id", 1, 2**31 - 1),
        "invalid_length_of_stay": f"{filled('length_of_stay')} and not coalesce(({stay}) >= 0, false)",
        "invalid_severity_code": not_whole("apr_severity_of_illness_code", 0, 4),
        "invalid_total_charges": f"{filled('total_charges')} and ({charges}) is null",
        "invalid_total_costs": f"{filled('total_costs')} and ({costs}) is null",
        "negative_total_charges": f"({charges}) < 0",
        "negative_total_costs": f"({costs}) < 0",
    }
    return " union all ".join(
        f"select '{n}' as rule, cast(sum({_one(r)}) as bigint) as violations from raw" for n, r in rules.items()
    )


def _audit() -> str:
    checks = {
        "rows": "count(*)",
        "distinct_name": "count(distinct nullif(facility_name, ''))",
        "null_name": "count(*) filter (where facility_name is null)",
        "empty_name": "count(*) filter (where facility_name = '')",
        "blank_name": "count(*) filter (where facility_name <> '' and trim(facility_name) = '')",
        "distinct_trimmed": "count(distinct nullif(trim(facility_name), ''))",
        "distinct_case_folded": "count(distinct lower(nullif(facility_name, '')))",
        "control_or_special_space": r"count(*) filter (where regexp_matches(facility_name, '[\x00-\x1f\x7f\x{00a0}\x{feff}]'))",
        "distinct_id": "count(distinct permanent_facility_id)",
        "distinct_id_or_name": "count(distinct coalesce(permanent_facility_id, facility_name))",
    }
    return " union all ".join(
        f"select '{n}' as check_name, '{s}' as source, cast({e} as bigint) as value from {t}"
        for s, t in (("raw", "raw"), ("clean", "fact"))
        for n, e in checks.items()
    )


def _cross() -> str:
    counts = " union all ".join(
        f"select '{s}' as source, cast(count(*) as bigint) as \"rows\", cast(count(distinct nullif(facility_name, '')) as bigint) as facilities from fact"
        for s in ("stage", "csv", "table")
    )
    return (
        'select *, min("rows") over () = max("rows") over () and min(facilities) over () = max(facilities) over () as passed '
        f"from ({counts})"
    )


# ---- questions --------------------------------------------------------------------------------


def _any(words) -> str:
    return "(" + " or ".join(f"contains(query, {_quote(w)})" for w in words) + ")"


def _first(rules, default: str) -> str:
    return "case " + " ".join(f"when {_any(w)} then '{n}'" for n, w in rules.items()) + f" else '{default}' end"


def _all_metrics(rules) -> str:
    parts = ", ".join(f"case when {_any(w)} then '{n}' end" for n, w in rules.items())
    return f"coalesce(nullif(concat_ws(',', {parts}), ''), 'count,avg_length_of_stay')"


LIMIT = (
    f"case when regexp_matches(query, '{Q.TOP_PATTERN}') "
    f"then least(greatest(cast(regexp_extract(query, '{Q.TOP_PATTERN}', 1) as int), 1), 50) else 20 end"
)
ASKED_YEAR = f"cast(nullif(regexp_extract(query, '{Q.YEAR_PATTERN}', 1), '') as int)"
ACCEPTED = r"length(regexp_replace(query, '^\s+|\s+$', '', 'g')) between 1 and 500"
CONFIDENCE = f"cast(case when {_any([w for ws in Q.DIMENSION_RULES.values() for w in ws])} then 0.92 else 0.65 end as double)"
INTENT = {
    "dimension": _first(Q.DIMENSION_RULES, "age_group"),
    "metrics": _all_metrics(Q.METRIC_RULES),
    "chart_type": _first(Q.CHART_RULES, "bar"),
    "limit": LIMIT,
    "year": ASKED_YEAR,
    "confidence": CONFIDENCE,
}
TAGGED = (
    f"tagged as (select conv_id, turn, {ACCEPTED} as accepted, "
    + ", ".join(f'case when {ACCEPTED} then {e} end as "{n}"' for n, e in INTENT.items())
    + " from questions)"
)


def _question(expression: str, name: str) -> str:
    return f'with {QUESTIONS} select conv_id, turn, {expression} as "{name}" from questions'


def _book() -> list[str]:
    """Ranked groups per dimension and year (null for all years), and the answers."""
    dims = " union all ".join(
        f"select '{d}' as dimension, cast({A.DIMENSIONS[d]} as varchar) as dimension_value, discharge_year, length_of_stay, total_charges, total_costs from fact"
        for d in Q.DIMENSION_RULES
    )
    metrics = ", ".join(f'{e} as "{m}"' for m, e in METRICS.items())
    both = (
        f"select dimension, cast(null as int) as year, dimension_value, {metrics} from unfolded group by all "
        f"union all select dimension, cast(discharge_year as int), dimension_value, {metrics} from unfolded where discharge_year is not null group by dimension, discharge_year, dimension_value"
    )
    ranked = (
        "select *, sum(\"count\") over (partition by dimension, year) as total, cast(row_number() over (partition by dimension, year order by "
        "case when dimension = 'year' then cast(dimension_value as int) end nulls first, "
        "case when dimension <> 'year' then \"count\" end desc nulls last, dimension_value nulls first) as int) as rank from both_scopes"
    )
    shown = ", ".join(
        f"case when list_contains(string_split(t.metrics, ','), '{m}') then b.\"{m}\" end as \"{m}\"" for m in METRICS
    )
    answer = (
        f"select t.conv_id, t.turn, t.dimension, t.year, b.rank, b.dimension_value, {shown}, "
        "case when t.dimension = 'payment' and t.metrics = 'count' then round(cast(b.\"count\" as double) / cast(b.total as double), 6) end as ratio "
        "from tagged t join book b on t.dimension = b.dimension and t.year is not distinct from b.year and b.rank <= t.\"limit\" where t.accepted"
    )
    return [
        QUESTIONS, TAGGED, f"unfolded as ({dims})", f"both_scopes as ({both})", f"book as ({ranked})", f"answer as ({answer})",
    ]


def _label_case(c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in A.DIMENSION_LABELS.items()) + f" else {c} end"


def _sentence(count: str = "count", groups: str = "groups") -> str:
    lead = answers.LEAD_SENTENCE.split("%s")
    label, value = _label_case("dimension"), LABEL.format("dimension_value")
    text = f"{_quote(lead[0])} || {label} || {_quote(lead[1])} || {groups} || {_quote(lead[2])} || {value} || {_quote(lead[3])} || format('{{:,}}', coalesce(\"{count}\", 0)) || {_quote(lead[4])}"
    pieces = [
        (answers.RATIO_SENTENCE.replace("%%", "%"), "ratio", "format('{:.1f}', ratio * 100)"),
        (answers.STAY_SENTENCE, "avg_length_of_stay", "format('{:.1f}', avg_length_of_stay)"),
        (answers.CHARGE_SENTENCE, "avg_total_charges", "format('{:,}', cast(round_even(avg_total_charges, 0) as bigint))"),
    ]
    for sentence, column, shown in pieces:
        a, b = sentence.split("%s")
        text += f" || coalesce({_quote(a)} || case when {column} is not null then {shown} end || {_quote(b)}, '')"
    return text


def _summary_text() -> str:
    empty = answers.EMPTY_SENTENCE.split("%s")
    nothing = f"{_quote(empty[0])} || {_label_case('dimension')} || {_quote(empty[1])}"
    return (
        f"select conv_id, turn, dimension, case when groups = 0 then {nothing} else {_sentence()} end as summary from ("
        "select t.conv_id, t.turn, t.dimension, (select count(*) from answer a where a.conv_id = t.conv_id and a.turn = t.turn) as groups, "
        "f.dimension_value, f.\"count\", f.ratio, f.avg_length_of_stay, f.avg_total_charges from tagged t "
        "left join answer f on f.conv_id = t.conv_id and f.turn = t.turn and f.rank = 1 where t.accepted)"
    )


def _report() -> str:
    parts = []
    shown = {"disease": ["avg_total_charges"], "age_group": ["avg_length_of_stay", "avg_total_charges"], "payment": ["ratio"]}
    for i, (title, dim, limit) in enumerate(answers.DEFAULT_SECTIONS):
        rows = _agg(dim, ["count", "avg_length_of_stay", "avg_total_charges"], limit)
        value = {m: m if m in shown[dim] else "cast(null as double)" for m in ("avg_length_of_stay", "avg_total_charges")}
        ratio = "cast(null as double)"
        if "ratio" in shown[dim]:
            ratio = 'round(cast("count" as double) / (select cast(count(*) as double) from fact), 6)'
        parts.append(
            f"select {i} as position, {_quote(title)} as title, '{dim}' as dimension, (select count(*) from ({rows})) as groups, dimension_value, "
            f"\"count\", {ratio} as ratio, {value['avg_length_of_stay']} as avg_length_of_stay, {value['avg_total_charges']} as avg_total_charges "
            f"from ({rows} ) where true qualify row_number() over (order by \"count\" desc, dimension_value nulls first) = 1"
        )
    body = f"'## ' || title || chr(10) || chr(10) || ({_sentence()}) || chr(10)"
    return (
        f"select '{answers.REPORT_TITLE}' as title, '# {answers.REPORT_TITLE}' || chr(10) || chr(10) || "
        f"string_agg({body}, chr(10) order by position) as content from ({' union all '.join(f'({p})' for p in parts)})"
    )


# ---- sampling ---------------------------------------------------------------------------------


def _below(fraction_sql: str, seed: int) -> str:
    """The row hash falls below the fraction; a fraction of one or more keeps all."""
    bound = f"printf('%08x', cast(floor(least({fraction_sql}, cast(0.9999999 as double)) * cast(4294967296 as double)) as bigint))"
    return f"({fraction_sql} >= 1 or substr(sha256(row_hash || ':{seed}'), 1, 8) < {bound})"


def _split(table: str) -> str:
    return f"select *, {_below('cast(0.8 as double)', 43)} as is_train from {table}"


def _sampled(rows: int, table: str) -> str:
    """The rows of ``table`` whose hash lies below the share that gives about ``rows`` of them."""
    fraction = f"(select cast({rows} as double) / cast(greatest(count(*), 1) as double) from {table})"
    return f"select * from {table} where {fraction} >= 1 or {_below(fraction, 42)}"


MODEL_TABLES = [
    f"marked as (select * from ({_split('fact')}) where total_costs is not null)", "train as (select * from marked where is_train)",
    f"fitted as ({_sampled(2000, 'train')})",
]
MODEL_FEATURES = [
    "age_group", "gender", "type_of_admission", "ccsr_diagnosis_code", "apr_severity_of_illness_desc", "apr_risk_of_mortality",
    "apr_medical_surgical_desc", "emergency_department_indicator", "payment_typology_1",
]


def _floor_div(a: str, b: str) -> str:
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def _boosted(rounds: int = 5) -> list[str]:
    """Five rounds of one-level trees over the feature combinations; ties to the earlier feature and the smaller left side."""
    known = ", ".join(f"coalesce({c}, chr(30)) as {c}" for c in MODEL_FEATURES)
    features = ", ".join(MODEL_FEATURES)
    steps = [
        *MODEL_TABLES[:2],
        f"cells as materialized (select {features}, cast(count(*) as bigint) as n, cast(sum(c) as bigint) as total from (select {known}, cast(total_costs * 100 as bigint) as c from train) group by all)",
        f"base as materialized (select cast({_floor_div('sum(total)', 'sum(n)')} as bigint) as base from cells)",
        f"c0 as materialized (select {features}, n, cast(total - n * base as bigint) as r from cells, base)",
    ]
    for i in range(rounds):
        long = " union all ".join(f"select {k} as feature, {f} as category, n, r from c{i}" for k, f in enumerate(MODEL_FEATURES))
        pick = "case b.feature " + " ".join(f"when {k} then x.{f}" for k, f in enumerate(MODEL_FEATURES)) + " end"
        high_r, high_n = "(r_all - r_low)", "(n_all - n_low)"
        gain = lambda r, n: f"cast({_floor_div(r, n)} as hugeint) * cast({r} as hugeint)"
        steps += [
            f"s{i} as (select feature, category, cast(sum(n) as bigint) as n, cast(sum(r) as bigint) as r from ({long}) group by all)",
            f"o{i} as materialized (select feature, category, row_number() over w as place, cast(sum(n) over w as bigint) as n_low, cast(sum(r) over w as bigint) as r_low, "
            f"cast(sum(n) over (partition by feature) as bigint) as n_all, cast(sum(r) over (partition by feature) as bigint) as r_all "
            f"from (select *, {_floor_div('r', 'n')} as mean from s{i}) window w as (partition by feature order by mean, category rows between unbounded preceding and current row))",
            f"b{i} as materialized (select feature, place, {_floor_div('r_low', '(2 * n_low)')} as low, {_floor_div(high_r, f'(2 * {high_n})')} as high from o{i} "
            f"where n_all > n_low order by {gain('r_low', 'n_low')} + {gain(high_r, high_n)} desc, feature, place limit 1)",
            f"l{i} as materialized (select o.feature, o.category from o{i} o, b{i} b where o.feature = b.feature and o.place <= b.place)",
            f"c{i + 1} as materialized (select x.* replace (cast(x.r - x.n * (case when l.category is null then b.high else b.low end) as bigint) as r) "
            f"from c{i} x cross join b{i} b left join l{i} l on l.category = {pick})",
        ]
    pred, joins = "base", ""
    for i in range(rounds):
        pick = f"case b{i}.feature " + " ".join(f"when {k} then coalesce(x.{f}, chr(30))" for k, f in enumerate(MODEL_FEATURES)) + " end"
        joins += f" cross join b{i} left join l{i} on l{i}.category = {pick}"
        pred += f" + case when l{i}.category is null then b{i}.high else b{i}.low end"
    steps.append(f"boosted as (select x.row_hash, x.total_costs, cast({pred} as bigint) as predicted_cents from marked x cross join base{joins} where not x.is_train)")
    return steps


def _relaxed() -> str:
    tokens = _in(X.MISSING_TOKENS)
    tokened = ", ".join(f"case when {c} not in {tokens} then {c} end as {c}" for c in NAMES)
    clip = "case when ({0}) < 0 then cast(0 as double) else ({0}) end".format
    special = {
        "length_of_stay": "try_cast(regexp_extract(length_of_stay, '([0-9]+)', 1) as int)",
        "discharge_year": f"case when ({_double('discharge_year')}) = floor({_double('discharge_year')}) then try_cast(({_double('discharge_year')}) as smallint) end",
        "apr_severity_of_illness_code": f"case when ({_double('apr_severity_of_illness_code')}) = floor({_double('apr_severity_of_illness_code')}) then try_cast(({_double('apr_severity_of_illness_code')}) as smallint) end",
        "total_charges": clip(_double(_plain("total_charges"))),
        "total_costs": clip(_double(_plain("total_costs"))),
        "birth_weight": "case when type_of_admission = 'Newborn' then coalesce(birth_weight, '') end",
    }
    columns = ", ".join(f"{special.get(n, f'''coalesce({n}, '')''')} as {n}" for n in NAMES)
    return f"select {columns} from (select distinct {tokened} from raw)"


def _money(c: str) -> str:
    return _double(_plain(c))


def _strict_columns(names) -> str:
    return f"select {STRICT['permanent_facility_id']} as facility, " + ", ".join(f"{STRICT[n]} as {n}" for n in names) + " from raw"


def _whole(c: str, dtype: str = "smallint") -> str:
    return f"case when ({_double(c)}) = floor({_double(c)}) then try_cast(({_double(c)}) as {dtype}) end"


def _clip(e: str) -> str:
    return f"case when ({e}) < 0 then cast(0 as double) else ({e}) end"


STRICT_WITHOUT_NEGATIVE = f"select {', '.join(f'{e} as {n}' for n, e in STRICT.items())} from raw where length_of_stay is distinct from '-1'"
EMPTY_REPORT = """
select '医疗大数据洞察报告' as title, '# 医疗大数据洞察报告' || chr(10) || chr(10)
  || '## 疾病住院量与费用' || chr(10) || chr(10) || '未查询到「疾病」下的有效数据，请调整筛选条件后重试。' || chr(10) || chr(10)
  || '## 患者年龄结构' || chr(10) || chr(10) || '未查询到「年龄段」下的有效数据，请调整筛选条件后重试。' || chr(10) || chr(10)
  || '## 支付方式构成' || chr(10) || chr(10) || '未查询到「支付方式」下的有效数据，请调整筛选条件后重试。' || chr(10) as content
"""


def oracle_sql() -> dict[str, str]:
    hashed = f"hashed as (select *, {_hash(NAMES)} as row_hash from raw)"
    dedup_keys, single = ", ".join(R.DEDUP_KEYS), ", ".join(R.SINGLE_KEYS)

    def dedup(direction: str) -> str:
        return on_raw(
            f"select {dedup_keys}, total_charges, row_hash from hashed "
            f"qualify row_number() over (partition by {dedup_keys} order by row_hash {direction}) = 1", hashed
        )

    invalid = " and ".join(
        f"({e}) is null"
        for e in (
            "nullif(facility_name, '')", "nullif(age_group, '')", "try_cast(regexp_extract(length_of_stay, '([0-9]+)', 1) as int)",
            _whole("discharge_year"), "nullif(ccsr_diagnosis_description, '')", "nullif(payment_typology_1, '')",
            _money("total_charges"), _money("total_costs"),
        )
    )
    newest = "select * from ledger where run_id = (select max(run_id) from ledger) qualify row_number() over (partition by run_id order by event_seq desc) = 1"
    iso = "strftime({}, '%Y-%m-%dT%H:%M:%S')".format
    sql = {
        "scan_csv": on_raw("select " + ", ".join(f"nullif({n}, '') as {n}" for n in NAMES) + " from raw"),
        "scan_jsonl": on_raw("select * from raw"),
        "project_canonical": on_raw("select * from raw"),
        "scan_csv_multiline": on_raw(
            "select " + ", ".join("nullif(replace(facility_name, ' ', chr(10)), '') as facility_name" if n == "facility_name" else f"nullif({n}, '') as {n}" for n in NAMES) + " from raw"
        ),
        "stream_state_dedup": on_fact("select row_hash, discharge_year, facility_name, length_of_stay, total_charges, total_costs from fact"),
        "uncommitted_load": on_fact(
            "select case when age_group = '0 to 17' then 'a' else 'c' end as load, row_hash, source_rows, total_costs, discharge_year from fact where age_group = '0 to 17' or gender = 'M'"
        ),
        "stream_ingest": on_fact("select row_hash, discharge_year, facility_name, length_of_stay, total_charges, total_costs from fact"),
        "ingest_strict": on_fact("select * from fact"),
        "bad_records": on_raw(
            "select cast(count(*) as bigint) as records, cast(count(*) filter (where length_of_stay = '') as bigint) as padded, "
            "cast(count(*) filter (where length_of_stay = '-1') as bigint) as rejected from raw"
        ),
        "ledger_state": f"with {LEDGER} select * exclude (started_at, finished_at), {iso('started_at')} as started_at from ledger "
        "qualify row_number() over (partition by run_id order by event_seq desc) = 1",
        "ledger_latest": f"with {LEDGER} select run_id, status, source_file, {iso('started_at')} as started_at, {iso('finished_at')} as finished_at, "
        "rows_read, rows_inserted, rows_dropped, error_message, cast(json_extract(quality_json, '$.overall') as double) as overall, "
        f"cast(json_extract(quality_json, '$.sample_size') as bigint) as sample_size from ({newest})",
        "row_reconcile": on_fact(
            "select cast(r as bigint) as rows_read, cast(k as bigint) as rows_inserted, cast(r - k as bigint) as rows_dropped, r = k + (r - k) as reconciled "
            "from (select (select count(*) from raw) as r, (select count(*) from fact) as k)"
        ),
        "reconcile_after_insert": on_fact(
            "select cast(r as bigint) as rows_read, cast(k as bigint) as rows_inserted, cast(r - k as bigint) as rows_dropped, true as reconciled "
            "from (select (select count(*) from raw) + (select count(*) from raw where age_group = '0 to 17') as r, (select count(*) from fact) as k)"
        ),
        "relaxed_identity": on_raw(
            "select cast(count(*) as bigint) as rows, cast(count(*) as bigint) as identities, (select cast(count(*) as hugeint) from raw) as source_rows "
            f"from (select distinct * from ({_relaxed()}))"
        ),
        "stream_ledger": on_fact(
            "select cast(7 as bigint) as run_id, 'completed' as status, true as ended, cast(r as bigint) as rows_read, cast(k as bigint) as rows_inserted, "
            "cast(r - k as bigint) as rows_dropped, cast(0 as bigint) as rows_rejected, sample_size, overall "
            f"from (select (select count(*) from raw) as r, (select count(*) from fact) as k), ({STRICT_REPORT})"
        ),
        "report_empty_section": EMPTY_REPORT,
        "stream_rejects": on_fact(
            "select 'completed' as status, cast(r as bigint) as rows_read, cast(k as bigint) as rows_inserted, cast(r - k as bigint) as rows_dropped, "
            "cast(x as bigint) as rows_rejected, cast(x as bigint) as quarantined, 'too many fields' as reason from ("
            "select count(*) filter (where length_of_stay is distinct from '-1') as r, count(*) filter (where length_of_stay = '-1') as x from raw), "
            "(select count(*) as k from (select distinct * from (" + STRICT_WITHOUT_NEGATIVE + ")))"
        ),
        "dedup_full": on_raw("select distinct * from raw"),
        "dedup_first": dedup("asc"),
        "dedup_last": dedup("desc"),
        "dedup_none": on_raw(
            f"select {single}, total_charges from raw qualify count(*) over (partition by {single}) = 1"
        ),
        "clean_money": on_raw(f"select {_money('total_charges')} as total_charges, {_money('total_costs')} as total_costs, total_charges as charges_text from raw"),
        "clean_money_floor": on_raw(
            f"select {_clip(_money('total_charges'))} as total_charges, {_clip(_money('total_costs'))} as total_costs, total_charges as charges_text from raw"
        ),
        "clean_birth_weight": on_raw("select type_of_admission, case when type_of_admission = 'Newborn' then birth_weight end as birth_weight from raw"),
        "clean_los_relaxed": on_raw("select try_cast(regexp_extract(length_of_stay, '([0-9]+)', 1) as int) as length_of_stay, length_of_stay as stay_text from raw"),
        "clean_types": on_raw(
            "select permanent_facility_id, try_cast(regexp_extract(length_of_stay, '([0-9]+)', 1) as int) as length_of_stay, "
            f"{_whole('discharge_year')} as discharge_year, {_whole('apr_severity_of_illness_code')} as apr_severity_of_illness_code, "
            f"{_clip(_money('total_charges'))} as total_charges, {_clip(_money('total_costs'))} as total_costs from raw"
        ),
        "fill_missing": on_raw(
            "select " + ", ".join(f"coalesce({c}, '{'Unknown' if c == 'ethnicity' else ''}') as {c}" for c in R.SPARSE) + " from raw"
        ),
        "clean_relaxed": on_raw(_relaxed()),
        "clean_stats": on_raw(
            "select cast((select count(*) from raw) as bigint) as rows_read, cast(count(*) filter (where not bad) as bigint) as rows_after_clean, "
            "cast((select count(*) from raw) - count(*) as bigint) as duplicates_removed, cast(count(*) filter (where bad) as bigint) as invalid_rows_removed "
            f"from (select distinct *, ({invalid}) as bad from raw)"
        ),
        "clean_strict_text": on_raw(_strict_columns([c for c in TEXT_COLUMNS if c != "birth_weight"])),
        "clean_los_strict": on_raw(_strict_columns(["length_of_stay"])),
        "clean_strict_codes": on_raw(_strict_columns(["discharge_year", "apr_severity_of_illness_code"])),
        "clean_money_strict": on_raw(_strict_columns(["total_charges", "total_costs"])),
        **{f"q_{n}": on_raw(f"select {_score(n)} as {n} from raw") for n in quality.SCORES},
        "q_uniqueness": on_raw(f"select {RAW_UNIQUE} as uniqueness from raw"),
        "q_assess": on_raw(ASSESS),
        "q_accumulate": on_raw(ASSESS),
        "q_strict": on_fact("select " + ", ".join(f"{_strict_score(n)} as {n}" for n in quality.SCORES) + " from fact"),
        "q_strict_overall": on_fact(STRICT_REPORT),
        "q_percent": on_fact(
            "select " + ", ".join(f"round({n} * 100, 2) as {n}_percent" for n in quality.SCORES)
            + f", round(uniqueness * 100, 2) as pass_rate_percent, round(overall * 100, 2) as overall_percent from ({STRICT_REPORT})"
        ),
        "q_cells": on_fact(_cells()),
        **{f"agg_{d}": on_fact(_agg(d)) for d in A.DIMENSIONS},
        "agg_all_metrics": on_fact(_agg("service_area", list(METRICS))),
        "los_by_age": on_fact(_agg("age_group", STAY_METRICS)),
        "cost_by_disease": on_fact(_agg("disease", COST_METRICS)),
        "payment_ratio": on_fact(PAYMENT),
        "year_trend": on_fact(TREND),
        "trend_series": on_fact(f'select year, "count", round(avg_length_of_stay, 2) as avg_length_of_stay from ({TREND})'),
        "trend_available": on_fact("select cast(count(distinct discharge_year) as bigint) as years, count(distinct discharge_year) >= 2 as trend_available from fact"),
        "overview_summary": on_fact(SUMMARY),
        "overview_kpis": on_fact(
            f"select discharges as records, round(avg_length_of_stay, 2) as avg_length_of_stay, round(avg_total_charges, 0) as avg_total_charges, facilities from ({SUMMARY})"
        ),
        "overview_long": on_fact(_overview()),
        "dimension_values": on_fact(f"select dimension_value from ({_agg('mortality_risk', ['count'], 100)}) where dimension_value is not null and dimension_value <> ''"),
        "distinct_facilities": on_fact("select cast(count(distinct nullif(facility_name, '')) as bigint) as facilities from fact"),
        "filter_combo": on_fact(
            _agg("disease", ["count", "avg_total_costs"], 20, "discharge_year = 1997 and gender = 'F' and hospital_service_area = 'ASIA'")
        ),
        "top_hospitals": on_fact(_agg("hospital", ["count"], 10)),
        "share_of_shown": on_fact(f"select *, {SHARE} as percent from ({_agg('disease', ['count'], 8)})"),
        "top_group": on_fact(_agg("age_group", ["count"], 1)),
        "patient_segments": on_fact(_segments()),
        "disease_table": on_fact(
            f"select {LABEL.format('dimension_value')} as name, \"count\", round(avg_length_of_stay, 1) as days, round(avg_total_charges, 0) as charges "
            f"from ({_agg('disease', STAY_METRICS, 8)})"
        ),
        "gender_share": on_fact(
            f"select case dimension_value when 'F' then '女性' when 'M' then '男性' else '未知' end as label, round({SHARE}, 1) as percent from ({_agg('gender', ['count'], 10)})"
        ),
        "payment_percent": on_fact(f"select {LABEL.format('payment')} as name, round(100 * ratio, 2) as percent from ({PAYMENT})"),
        "tag_dimension": _question(_first(R.LOCAL_DIMENSIONS, "age_group"), "dimension"),
        "tag_metrics": _question(_all_metrics(R.LOCAL_METRICS), "metrics"),
        "tag_chart": _question(_first(R.LOCAL_CHARTS, "bar"), "chart_type"),
        "extract_limit": _question(LIMIT, "limit"),
        "extract_year": _question(ASKED_YEAR, "year"),
        "intent_struct": f"with {QUESTIONS}, {TAGGED} select * from tagged",
        "question_rejects": f"with {QUESTIONS}, {TAGGED} select cast(count(*) filter (where accepted) as bigint) as accepted, cast(count(*) filter (where not accepted) as bigint) as rejected from tagged",
        "answer_batch": on_fact("select * from answer", *_book()),
        "summary_text": on_fact(_summary_text(), *_book()),
        "report_markdown": on_fact(_report()),
        "route_rules": _question(
            "case " + " ".join(f"when regexp_matches(query, '{p}') then '{n}'" for n, p in Q.ROUTE_PATTERNS.items()) + " else 'trend' end", "route"
        ),
        "profile_columns": on_fact(_profile()),
        "profile_top_values": on_fact(_top_values()),
        "profile_heavy_hitters": on_fact(_top_values()),
        "profile_sketches": on_fact(" union all ".join(
            f"select '{c}' as column_name, cast(count(*) as bigint) as rows, cast(count(*) - count({c}) as bigint) as missing, cast(count(distinct {c}) as bigint) as distinct_values, true as within_bound from fact"
            for c in NAMES
        )),
        "cube_after_two_loads": on_fact(" union all ".join(
            f"select '{d}' as dimension, cast({c} as varchar) as dimension_value, " + ", ".join(f'{m} as "{n}"' for n, m in METRICS.items()) + f" from fact group by {c}"
            for d, c in A.DIMENSIONS.items()
        )),
        "overview_cube": on_fact(_overview()),
        "cross_source_diff": on_fact(
            "select row_hash, facility_name, total_costs, 'left' as side, cast(1 as bigint) as times from fact where row_hash not in (select row_hash from hashed) "
            "union all select row_hash, facility_name, total_costs, 'right', 1 from hashed where row_hash not in (select row_hash from fact)",
            "copied as (select * replace (cast(total_costs + case when row_hash like '00%' then 1 else 0 end as decimal(14,2)) as total_costs) from fact where row_hash not like '01%')",
            f"hashed as (select * replace ({_hash(NAMES)} as row_hash) from copied)",
        ),
        "dup_estimate": on_raw(
            "select cast(n as bigint) as rows_examined, cast(u as bigint) as distinct_rows, cast(n - u as bigint) as duplicate_rows, cast(n - u as double) / cast(n as double) as duplicate_rate "
            "from (select count(*) as n, count(distinct row_hash) as u from hashed)", hashed
        ),
        "anomaly_counts": on_raw(_anomalies()),
        "field_missing": on_fact(" union all ".join(
            f"select '{c}' as field, cast(count(*) - count({c}) as bigint) as missing_count, "
            f"round(100 * (cast(count(*) - count({c}) as double) / cast(count(*) as double)), 4) as missing_rate from fact"
            for c in profile.SNAPSHOT_FIELDS
        )),
        "birth_weight_context": on_raw(
            f"select type_of_admission, apr_mdc_code, apr_drg_code, {WEIGHT} as birth_weight, length_of_stay as length_of_stay_raw, "
            "try_cast(regexp_extract(length_of_stay, '([0-9]+)', 1) as int) as length_of_stay from raw"
        ),
        "facility_audit": on_fact(_audit()),
        "cross_source_check": on_fact(_cross()),
        "row_hash": on_fact("select row_hash, facility_name, discharge_year, source_rows from fact"),
        "incremental_insert": on_fact("select row_hash, discharge_year, age_group, total_charges, source_rows from fact where age_group = '0 to 17'"),
        "fill_absent_columns": on_raw(
            "select permanent_facility_id, cast(null as varchar) as race, cast(null as varchar) as payment_typology_3, total_costs, 'race,payment_typology_3' as absent from raw"
        ),
        "ml_sample": on_fact("select row_hash, total_costs from fitted", *MODEL_TABLES),
        "ml_split": on_fact(f"select row_hash, is_train from ({_split('fact')})"),
        "ml_index": on_fact(
            "select feature, category, cast(row_number() over (partition by feature order by n desc, category) - 1 as int) as index from ("
            "select feature, category, count(*) as n from (unpivot (select " + ", ".join(MODEL_FEATURES) + " from fitted) on "
            + ", ".join(MODEL_FEATURES) + " into name feature value category) group by all)", *MODEL_TABLES
        ),
        "ml_score_rows": on_fact("select row_hash, true as scored from fact"),
        "ml_baseline": on_fact(
            "select cast(count(*) as bigint) as test_rows, max(m) as train_median, round(avg(abs(cast(total_costs as double) - m)), 4) as baseline_mae "
            "from marked, (select median(cast(total_costs as double)) as m from fitted) where not is_train", *MODEL_TABLES
        ),
        "ml_sample_exact": on_fact(f"select row_hash, total_costs from train order by sha256(row_hash || ':42') limit {R.MODEL_ROWS}", *MODEL_TABLES[:2]),
        "ml_median_all": on_fact(
            "select (select cast(count(*) as bigint) from train) as train_rows, max(m) as median_cents, cast(count(*) as bigint) as test_rows, "
            "cast(sum(abs(2 * cast(total_costs * 100 as bigint) - cast(2 * m as bigint))) as bigint) as twice_error_cents "
            "from marked, (select median(cast(total_costs * 100 as bigint)) as m from train) where not is_train", *MODEL_TABLES[:2]
        ),
        "ml_boost_scores": on_fact("select row_hash, total_costs, predicted_cents from boosted", *_boosted()),
        "ml_boost_metrics": on_fact(
            "select cast(count(*) as bigint) as rows, cast(sum(abs(c - predicted_cents)) as bigint) as error_cents, "
            "cast(sum(abs(c - predicted_cents)) as double) / cast(count(*) as double) as mean_error_cents from (select *, cast(total_costs * 100 as bigint) as c from boosted)", *_boosted()
        ),
        "bench_overview": on_fact(SUMMARY),
        "bench_diseases_top": on_fact(_agg("disease", ["count"], 10)),
        "bench_diseases_cost": on_fact(_agg("disease", COST_METRICS, 10)),
        "bench_hospitals_top": on_fact(_agg("hospital", ["count"], 10)),
        "bench_hospitals_cost": on_fact(_agg("hospital", COST_METRICS, 10)),
        "bench_age_distribution": on_fact(_agg("age_group", DEFAULT)),
        "bench_age_cost": on_fact(_agg("age_group", COST_METRICS)),
        "bench_payment_distribution": on_fact(PAYMENT),
        "bench_severity_distribution": on_fact(_agg("severity", DEFAULT)),
        "bench_yearly_trends": on_fact(TREND),
    }
    return sql
