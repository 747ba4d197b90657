"""DuckDB SQL that answers the registered queries independently.

Ties decide the last digit of a rounded value, so each result is rounded the
way its query rounds: percentages of a frame half up in whole numbers, other
values of a frame half up in decimal, pillar scores by their binary value.
"""

from __future__ import annotations

import string

from tabmeter.plans import advice

LINEITEM = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)
DQ_NUMBERS = ("order_id", "customer_id", "quantity", "sales", "discount_rate", "late_risk")
DATES = ("order_date_txt", "order_date", "ship_date")

WEIGHTS = {
    "completeness": 0.20,
    "validity": 0.15,
    "uniqueness": 0.10,
    "consistency": 0.15,
    "timeliness": 0.10,
    "accuracy": 0.15,
    "ai_readiness": 0.15,
}
LABELS = {
    "completeness": "Completeness",
    "validity": "Validity",
    "uniqueness": "Uniqueness",
    "consistency": "Consistency",
    "timeliness": "Timeliness",
    "accuracy": "Accuracy",
    "ai_readiness": "AI Readiness",
}


def pct(part: str, whole: str) -> str:
    return f"((20000 * CAST({part} AS BIGINT) + {whole}) // (2 * {whole})) / 100.0"


def half_up(value: str, digits: int = 4) -> str:
    """Rounds the decimal form of a double, as Spark does."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 14)), {digits}) AS DOUBLE)"


def nearest(value: str, digits: int = 2) -> str:
    """Rounds the binary value of a double, as Python and C do."""
    return f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def share(part: str, whole: str) -> str:
    return nearest(f"CAST({part} AS DOUBLE) / {whole} * 100")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def wave(k: int) -> str:
    """A column of many that depend on each other in part; every seventh has gaps."""
    value = f"l_quantity * {k % 5} + l_partkey % {k + 2}"
    return f"CASE WHEN {k} % 7 = 3 AND l_suppkey % 4 = 0 THEN NULL ELSE CAST({value} AS DOUBLE) END"


def oracles(dq_columns: dict[str, str]) -> dict[str, str]:
    columns = ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in dq_columns.items())
    dq = (
        f"dq AS (SELECT {columns} FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
        f"size AS (SELECT count(*) AS n FROM dq)"
    )
    names = list(dq_columns)

    def over_dq(body: str) -> str:
        return f"WITH {dq} {body}"

    nulls = union(
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) - count({c}) AS null_count, "
        f"count(*) AS n FROM dq"
        for i, c in enumerate(names)
    )
    null_pct = f"SELECT *, {pct('null_count', 'n')} AS null_pct FROM ({nulls})"

    # -- conditions of the rules -------------------------------------------
    ranges = {
        "quantity": "(quantity < 1 OR quantity > 50)",
        "discount_rate": "(discount_rate < 0 OR discount_rate > 1)",
        "sales": "sales < 0",
    }
    enums = {
        "ship_mode": "trim(ship_mode) NOT IN ('A', 'N', 'R')",
        "delivery_status": "trim(delivery_status) NOT IN ('F', 'O', 'P')",
        "late_risk": "CAST(late_risk AS VARCHAR) NOT IN ('0', '1')",
    }
    parses = {
        "order_date_txt": "order_date_txt IS NOT NULL AND TRY_CAST(order_date_txt AS TIMESTAMP) IS NULL",
        "order_date": "false",
        "ship_date": "false",
    }
    ids = {"order_id": "order_id IS NULL", "customer_id": "customer_id IS NULL"}
    late = "ship_date < order_date"
    mismatch = "late_risk = 1 AND trim(delivery_status) IS DISTINCT FROM 'F'"
    unsold = "quantity > 0 AND sales <= 0"

    def violations(rules: dict[str, str]) -> str:
        return over_dq(
            union(
                f"SELECT '{c}' AS \"column\", count_if({test}) AS violations, "
                f"{pct(f'count_if({test})', 'count(*)')} AS violation_pct FROM dq"
                for c, test in rules.items()
            )
        )

    def tally(pillar: str, tests: list[str], rows: str = "dq") -> str:
        """Score from conditions which no row may fulfil."""
        passed = " + ".join(f"CAST(count_if({t}) = 0 AS INT)" for t in tests)
        n = len(tests)
        return (
            f"SELECT '{pillar}' AS pillar, {nearest(f'({passed}) * 100.0 / {n}')} AS score, "
            f"CAST({passed} AS INT) AS passed_checks, {n} AS total_checks, "
            f"CAST({n} - ({passed}) AS INT) AS issue_count FROM {rows}"
        )

    # -- pillars -------------------------------------------------------------
    gap_sum = " + ".join(f"CAST({c} IS NULL AS INT)" for c in names)
    sparse = f"count_if(({gap_sum}) * 2 > {len(names)})"
    bad_pct = share(sparse, "count(*)")
    mean_score = f"avg(100 - {share('null_count', 'n')}) - 0.5 * (SELECT {bad_pct} FROM dq)"
    completeness = (
        f"SELECT 'completeness' AS pillar, {nearest(f'greatest(0, {mean_score})')} AS score, "
        f"CAST(count_if(null_pct <= 20) AS INT) AS passed_checks, {len(names)} AS total_checks, "
        f"CAST((max(null_pct) >= 50) AS INT) "
        f"+ CAST(count_if(null_pct >= 20 AND null_pct < 50) > 0 AS INT) "
        f"+ CAST((SELECT {sparse} > 0 FROM dq) AS INT) AS issue_count FROM ({null_pct})"
    )
    validity = tally(
        "validity", [*ranges.values(), *enums.values(), *parses.values(), *ids.values()]
    )
    consistency = tally("consistency", [late, "false", mismatch, unsold])
    id_pct = share("count_if(order_id IS NULL)", "count(*)")
    id_pct2 = share("count_if(customer_id IS NULL)", "count(*)")
    dups = "(SELECT count(*) FROM dq) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dq))"
    uniqueness = (
        f"SELECT 'uniqueness' AS pillar, {nearest('greatest(0, greatest(0, 100 - 5 * dup_pct) - 0.5 * id1 - 0.5 * id2)')} AS score, "
        f"CAST(dup_pct <= 5 AS INT) + CAST(id1n = 0 AS INT) + CAST(id2n = 0 AS INT) AS passed_checks, 3 AS total_checks, "
        f"CAST(dup_pct > 5 AS INT) + CAST(id1n > 0 AS INT) + CAST(id2n > 0 AS INT) AS issue_count FROM ("
        f"SELECT {share(f'({dups})', 'count(*)')} AS dup_pct, {id_pct} AS id1, {id_pct2} AS id2, "
        f"count_if(order_id IS NULL) AS id1n, count_if(customer_id IS NULL) AS id2n FROM dq)"
    )
    parsed = {
        "order_date_txt": "TRY_CAST(order_date_txt AS TIMESTAMP)",
        "order_date": "CAST(order_date AS TIMESTAMP)",
        "ship_date": "CAST(ship_date AS TIMESTAMP)",
    }
    gaps = {
        c: f"SELECT coalesce(max(gap), 0) FROM (SELECT date_diff('day', lag(day) OVER (ORDER BY day), day) AS gap "
        f"FROM (SELECT DISTINCT CAST({p} AS DATE) AS day FROM dq WHERE {p} IS NOT NULL))"
        for c, p in parsed.items()
    }
    timely = []
    for c, p in parsed.items():
        timely += [
            f"(SELECT count_if({parses[c]}) = 0 FROM dq)",
            f"(SELECT min({p}) >= TIMESTAMP '1993-01-01' AND max({p}) <= TIMESTAMP '2030-12-31' FROM dq)",
            f"({gaps[c]}) <= 90",
        ]
    timely_sum = " + ".join(f"CAST(({t}) AS INT)" for t in timely)
    timeliness = (
        f"SELECT 'timeliness' AS pillar, {nearest('p * 100.0 / 9')} AS score, p AS passed_checks, "
        f"9 AS total_checks, 9 - p AS issue_count FROM (SELECT {timely_sum} AS p)"
    )

    def zscores(table: str, numbers) -> str:
        return union(
            f"SELECT '{c}' AS \"column\", {half_up('any_value(m)')} AS mean, {half_up('any_value(s)')} AS std, "
            f"count_if(abs(({c} - m) / s) > 3) AS outlier_count, "
            f"{pct(f'count_if(abs(({c} - m) / s) > 3)', 'count(*)')} AS outlier_pct "
            f"FROM {table}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {table})"
            for c in numbers
        )

    # The forest's share is its contamination, so its check passes.
    flag_pct = share("sum(outlier_count)", f"({len(DQ_NUMBERS)} * any_value(size.n))")
    accuracy = (
        f"SELECT 'accuracy' AS pillar, {nearest(f'greatest(0, 100 - 5 * {flag_pct})')} AS score, "
        f"CAST(1 + count_if(outlier_pct <= 5) AS INT) AS passed_checks, "
        f"{len(DQ_NUMBERS) + 1} AS total_checks, "
        f"CAST(count_if(outlier_pct > 5) AS INT) AS issue_count "
        f"FROM ({zscores('dq', DQ_NUMBERS)}), size"
    )
    features = ("quantity", "sales", "discount_rate")
    flat = " OR ".join(f"stddev_samp({c}) = 0" for c in features)
    skewed = " OR ".join(f"abs(skewness({c})) > 10" for c in features)
    collinear = " OR ".join(
        f"abs(corr({a}, {b})) >= 0.95" for i, a in enumerate(features) for b in features[:i]
    )
    balance = (
        "(SELECT round(min(k) / sum(k), 4) >= 0.15 FROM "
        "(SELECT count(*) AS k FROM dq WHERE late_risk IS NOT NULL GROUP BY late_risk))"
    )
    ready_sum = (
        f"CAST(NOT ({flat}) AS INT) + CAST(NOT ({collinear}) AS INT) + CAST(NOT ({skewed}) AS INT) "
        f"+ CAST(any_value({balance}) AS INT)"
    )
    ai_readiness = (
        f"SELECT 'ai_readiness' AS pillar, {nearest('p * 100.0 / 6')} AS score, p AS passed_checks, "
        f"6 AS total_checks, 6 - p AS issue_count FROM (SELECT {ready_sum} AS p FROM dq)"
    )
    pillars = {
        "completeness": completeness,
        "validity": validity,
        "uniqueness": uniqueness,
        "consistency": consistency,
        "timeliness": timeliness,
        "accuracy": accuracy,
        "ai_readiness": ai_readiness,
    }
    weight = "CASE pillar " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in WEIGHTS.items()) + " END"
    scored = (
        f"SELECT pillar, score, CAST({weight} AS DOUBLE) AS weight, "
        f"{nearest(f'score * CAST({weight} AS DOUBLE)', 4)} AS weighted_score, passed_checks, total_checks "
        f"FROM ({union(f'({q})' for q in pillars.values())})"
    )
    label = "CASE pillar " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in LABELS.items()) + " END"

    def status(value: str) -> str:
        return (
            f"CASE WHEN {value} >= 85 THEN 'Excellent' WHEN {value} >= 70 THEN 'Good' "
            f"WHEN {value} >= 50 THEN 'At Risk' ELSE 'Not Ready' END"
        )

    # -- findings: fixed wording, one row for each condition that holds ---------
    def finding(pillar: str, place: int, text: str, test: str, rows: str = "dq") -> str:
        return f"SELECT '{pillar}' AS pillar, {place} AS place, {text} AS issue FROM {rows} HAVING {test}"

    def said(*parts: str) -> str:
        """Texts as literals, and from "=" on as expressions, joined."""
        return " || ".join(f"CAST({x[1:]} AS VARCHAR)" if x.startswith("=") else "'" + x.replace("'", "''") + "'" for x in parts)

    def listed(test: str, rows: str) -> str:
        names = f"(SELECT string_agg(chr(39) || \"column\" || chr(39), ', ' ORDER BY ordinal) FROM (SELECT \"column\", ordinal FROM {rows} WHERE {test} ORDER BY ordinal LIMIT 5))"
        return f"'[' || {names} || ']'"

    def missing(place: int, test: str, limit: str) -> str:
        names, more = listed(test, f"({null_pct})"), f"CASE WHEN count_if({test}) > 5 THEN '…' ELSE '' END"
        text = said(f"=count_if({test})", f" column(s) have >{limit}% missing values: ", f"={names}", f"={more}")
        return finding("completeness", place, text, f"count_if({test}) > 0", f"({null_pct})")

    def count_and_pct(test: str) -> tuple[str, str]:
        return f"=count_if({test})", f"={nearest(share(f'count_if({test})', 'count(*)'))}"

    found = [
        missing(0, "null_pct >= 50", "50.0"),
        missing(1, "null_pct >= 20 AND null_pct < 50", "20.0"),
        finding(
            "completeness", 2, said(f"={sparse}", " rows (", f"={nearest(bad_pct)}", "%) have >50% of their fields missing"), f"{sparse} > 0"
        ),
    ]
    bounds = {"quantity": "[1, 50]", "discount_rate": "[0.0, 1.0]", "sales": "[0.0, None]"}
    for i, (c, test) in enumerate(ranges.items()):
        n, part = count_and_pct(test)
        text = said(f"Column '{c}': ", n, " values (", part, f"%) out of range {bounds[c]}")
        found.append(finding("validity", i, text, f"count_if({test}) > 0"))
    for i, (c, test) in enumerate(enums.items()):
        n, part = count_and_pct(test)
        sample = f"(SELECT string_agg(chr(39) || v || chr(39), ', ' ORDER BY v) FROM (SELECT DISTINCT trim(CAST({c} AS VARCHAR)) AS v FROM dq WHERE {test} ORDER BY v LIMIT 5))"
        text = said(f"Column '{c}': ", n, " invalid values (", part, "%) not in allowed set. Sample: [", f"={sample}", "]")
        found.append(finding("validity", 10 + i, text, f"count_if({test}) > 0"))
    for i, (c, test) in enumerate(parses.items()):
        n, part = count_and_pct(test)
        text = said(f"DateTime column '{c}': ", n, " values (", part, "%) could not be parsed")
        found.append(finding("validity", 20 + i, text, f"count_if({test}) > 0"))
        text = said(f"Column '{c}': ", n, " values could not be parsed as datetime")
        found.append(finding("timeliness", 10 * i, text, f"count_if({test}) > 0"))
        low, high = f"min({parsed[c]})", f"max({parsed[c]})"
        text = said(f"Column '{c}': earliest date ", f"=CAST({low} AS DATE)", " is before expected start 1993-01-01")
        found.append(finding("timeliness", 10 * i + 1, text, f"{low} < TIMESTAMP '1993-01-01'"))
        text = said(f"Column '{c}': latest date ", f"=CAST({high} AS DATE)", " is after expected end 2030-12-31")
        found.append(finding("timeliness", 10 * i + 2, text, f"{high} > TIMESTAMP '2030-12-31'"))
        text = said(f"Column '{c}': maximum temporal gap is ", f"=({gaps[c]})", " days (threshold: 90)")
        found.append(finding("timeliness", 10 * i + 3, text, f"({gaps[c]}) > 90"))
    for i, (c, test) in enumerate(ids.items()):
        n, part = count_and_pct(test)
        found.append(finding("validity", 30 + i, said(f"Required ID column '{c}' has ", n, " null values"), f"count_if({test}) > 0"))
        text = said(f"ID column '{c}' has ", n, " null values (", part, "%)")
        found.append(finding("uniqueness", 1 + i, text, f"count_if({test}) > 0"))
    repeated = share(f"({dups})", "count(*)")
    text = said(f"=({dups})", " duplicate rows found (", f"={nearest(repeated)}", "%) — exceeds threshold of 5.0%")
    found.append(finding("uniqueness", 0, text, f"{repeated} > 5"))
    n, part = count_and_pct(late)
    text = said("Rule 'shipping_after_order': ", n, " rows (", part, "%) violate 'ship_date' >= 'order_date'")
    found.append(finding("consistency", 0, text, f"count_if({late}) > 0"))
    text = said("Rule 'late_delivery_risk_vs_status': ", f"=count_if({mismatch})", " rows have late_risk=1 but 'delivery_status' != 'F'")
    found.append(finding("consistency", 1, text, f"count_if({mismatch}) > 0"))
    outlying = f"SELECT *, list_position({[*DQ_NUMBERS]}, \"column\") AS place FROM ({zscores('dq', DQ_NUMBERS)}) WHERE outlier_pct > 5"
    found.append(
        "SELECT 'accuracy', place, "
        + said("Column '", '="column"', "': ", "=outlier_count", " outliers (", "=outlier_pct", "%) detected via Z-score")
        + f" FROM ({outlying})"
    )
    found.append("SELECT 'ai_readiness', 0, 'Only 3 numeric feature columns available for ML (minimum: 5)'")
    found.append(
        "SELECT 'ai_readiness', 9, 'Potential data leakage: columns [''delivery_status''] may directly encode the target. "
        "Review before training.'"
    )
    issues = (
        "SELECT pillar, CAST(row_number() OVER (PARTITION BY pillar ORDER BY place) - 1 AS INTEGER) AS seq, issue "
        f"FROM ({union(f'({q})' for q in found)})"
    )

    overall = f"SELECT {nearest('sum(weighted_score)')} AS overall_score FROM ({scored})"

    # -- advice: fixed wording, in order of urgency, then of the pillars --------
    order = "CASE pillar " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(WEIGHTS)) + " END"

    def filled(message: str, **words: str) -> str:
        """The message with SQL expressions in its gaps."""
        parts = []
        for text, gap, _, _ in string.Formatter().parse(message):
            parts += ([text] if text else []) + ([f"={words[gap]}"] if gap else [])
        return said(*parts)

    def advised(pillar: str, place: int, priority: int, text: str, test: str, rows: str = "dq") -> str:
        return f"SELECT '{pillar}' AS pillar, {place} AS place, {priority} AS priority, {text} AS message FROM {rows} HAVING {test}"

    def by_score(scores: str) -> list[str]:
        return [
            f"SELECT '{p}' AS pillar, 0 AS place, CASE WHEN score < 60 THEN {low[0]} ELSE {mid[0]} END AS priority, "
            f"CASE WHEN score < 60 THEN {said(low[1])} ELSE {said(mid[1])} END AS message FROM ({scores}) WHERE pillar = '{p}' AND score < 80"
            for p, (low, mid) in advice.BY_SCORE.items()
        ]

    def ranked_advice(parts: list[str], tip: str) -> str:
        kept = f"SELECT message, min(priority * 10000 + {order} * 100 + place) AS urgency FROM ({union(parts)}) GROUP BY message"
        last = f"SELECT {said(advice.EXCELLENT_TIP)}, 1000000 WHERE ({tip}) >= 85"
        return (
            "SELECT CAST(row_number() OVER (ORDER BY urgency) AS INT) AS seq, message AS recommendation "
            f"FROM ({kept} UNION ALL {last}) QUALIFY row_number() OVER (ORDER BY urgency) <= 10"
        )

    bracketed = "'[' || string_agg(chr(39) || \"column\" || chr(39), ', ' ORDER BY place) || ']'"
    collinear_names = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", {100 * i + 10 * j + k} AS place "
        f"WHERE (SELECT abs(corr({a}, {b})) >= 0.95 FROM dq)"
        for i, a in enumerate(features)
        for j, b in enumerate(features[:i])
        for k, name in enumerate((a, b))
    )
    strong = f"SELECT \"column\", min(place) AS place FROM ({collinear_names}) GROUP BY \"column\" ORDER BY place LIMIT 6"
    told = by_score(scored) + [
        advised(
            "completeness", 1, 1,
            filled(advice.NULL_COLUMNS, names=listed("null_pct >= 50", f"({null_pct})")),
            "count_if(null_pct >= 50) > 0", f"({null_pct})",
        ),
        advised("completeness", 2, 2, filled(advice.NULL_ROWS, pct=nearest(bad_pct)), f"{bad_pct} > 10"),
        *(
            advised("validity", 1 + i, 3, filled(advice.ENUM_VALUES, column=f"'{c}'", n=f"count_if({test})"), f"count_if({test}) > 0")
            for i, (c, test) in enumerate(enums.items())
        ),
        advised("uniqueness", 1, 1, filled(advice.MANY_DUPLICATES, pct=nearest(repeated)), f"{repeated} > 10"),
        advised("uniqueness", 2, 2, filled(advice.SOME_DUPLICATES, pct=nearest(repeated)), f"{repeated} > 2 AND {repeated} <= 10"),
        advised("accuracy", 1, 2, filled(advice.OUTLIER_COLUMNS, names=bracketed), "count(*) > 0", f"({outlying} ORDER BY place LIMIT 5)"),
        advised("ai_readiness", 1, 1, filled(advice.LEAKAGE, names="'[''delivery_status'']'"), "true"),
        advised("ai_readiness", 2, 2, filled(advice.COLLINEAR, names=bracketed), "count(*) > 0", f"({strong})"),
        advised("ai_readiness", 3, 2, filled(advice.FEW_FEATURES), "true"),
    ]
    recommendations = ranked_advice(told, overall)
    number = "CAST({c} AS DOUBLE)"
    lineitem_profile = union(
        f"SELECT '{c}' AS \"column\", {half_up(f'avg({c})')} AS mean, {half_up(f'stddev_samp({c})')} AS std, "
        f"{half_up(f'min({c})')} AS min, {half_up(f'max({c})')} AS max, "
        f"count_if({c} = 0) AS zeros_count, {pct(f'count_if({c} = 0)', 'count(*)')} AS zeros_pct FROM lineitem"
        for c in LINEITEM
    )
    matrix = union(
        f"SELECT '{a}' AS row_column, '{b}' AS col_column, "
        f"round(corr({number.format(c=a)}, {number.format(c=b)}), 4) AS r FROM lineitem"
        for a in LINEITEM
        for b in LINEITEM
    )
    distinct = union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM {t}"
        for t, cols in (
            ("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
            ("documents", ("doc_id", "text", "lang", "source", "n_chars")),
        )
        for c in cols
    )

    def ranked(table: str, column: str, order: str, most: int) -> str:
        return (
            f"SELECT '{column}' AS \"column\", rank, CAST({column} AS VARCHAR) AS value, n FROM ("
            f"SELECT {column}, n, row_number() OVER (ORDER BY {order}) AS rank FROM ("
            f"SELECT {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})) "
            f"WHERE rank <= {most}"
        )

    def frequent(table: str, column: str) -> str:
        return ranked(table, column, f"n DESC, {column}", 5)

    def classified(table: str, kinds: dict[str, str]) -> str:
        parts = []
        for c, kind in kinds.items():
            if kind == "string":
                parsed_rate = f"count(TRY_CAST({c} AS TIMESTAMP)) / count({c})"
                other = f"count({c})"
            else:
                parsed_rate = "1.0"
                other = "1" if kind == "datetime" else f"count_if({c} NOT IN (0, 1))"
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS \"column\", '{kind}' AS kind, "
                f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
                f"{half_up(f'count(DISTINCT {c}) / count(*)')} AS cardinality_ratio, "
                f"{parsed_rate} AS rate, {other} AS other FROM {table}"
            )
        return union(parts)

    column_kinds = {
        "orders": {
            "o_orderkey": "number",
            "o_custkey": "number",
            "o_orderstatus": "string",
            "o_totalprice": "number",
            "o_orderdate": "datetime",
            "o_orderpriority": "string",
        },
        "events": {
            "event_id": "number",
            "ts": "datetime",
            "user_id": "number",
            "event_type": "string",
            "value": "number",
            "props": "string",
        },
        "documents": {
            "doc_id": "number",
            "text": "string",
            "lang": "string",
            "source": "string",
            "n_chars": "number",
        },
        "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
    }
    date_name = "regexp_matches(\"column\", '(date|time|timestamp|created|updated|shipped|order_date|ship)')"
    key = "regexp_matches(\"column\", '(\\bid\\b|_id$|^id_)') AND cardinality_ratio > 0.8"
    classes = (
        f"SELECT table_name, \"column\", CASE WHEN {date_name} AND rate >= 0.8 THEN 'datetime' "
        f"WHEN kind = 'datetime' THEN 'datetime' WHEN unique_count <= 2 AND other = 0 THEN 'boolean' "
        f"WHEN kind = 'number' AND {key} THEN 'id' WHEN kind = 'number' THEN 'numeric' "
        f"WHEN {key} THEN 'id' WHEN regexp_matches(\"column\", 'email|phone|mobile|tel') THEN 'text' "
        f"WHEN rate >= 0.8 THEN 'datetime' WHEN cardinality_ratio > 0.5 AND unique_count > 100 THEN 'text' "
        f"ELSE 'categorical' END AS semantic_type, null_count, unique_count, cardinality_ratio FROM ("
        + union(classified(t, kinds) for t, kinds in column_kinds.items())
        + ")"
    )
    spread_source = (
        "(SELECT *, 42.0::DOUBLE AS constant, CAST(l_orderkey % 5000 = 0 AS INT)::DOUBLE AS rare FROM lineitem)"
    )
    spread = union(
        f"SELECT '{c}' AS \"column\", stddev_samp({c}) = 0 AS zero_variance, "
        + (
            "0.0::DOUBLE AS skewness, false AS extreme_skew"
            if c == "constant"
            else f"round(skewness({c}), 4) AS skewness, abs(skewness({c})) > 10 AS extreme_skew"
        )
        + f" FROM {spread_source}"
        for c in (*LINEITEM, "constant", "rare")
    )
    rules = {
        "shipping_after_order": ("false", "true", late),
        "shipping_days_match": ("true", "true", "false"),
        "late_delivery_risk_vs_status": ("false", "late_risk = 1", mismatch),
        "sales_qty_consistency": ("false", "true", unsold),
        "discount_rate_range": ("false", "true", "discount_rate < 0 OR discount_rate > 1"),
    }
    all_violations = union(
        f"SELECT '{name}' AS rule, {skipped} AS skipped, count_if({scope}) AS scope_rows, "
        f"count_if({broken}) AS violations, {pct(f'count_if({broken})', 'count(*)')} AS violation_pct FROM dq"
        for name, (skipped, scope, broken) in rules.items()
    )
    windows = union(
        f"SELECT '{c}' AS \"column\", CAST(CAST(min({p}) AS DATE) AS VARCHAR) AS min_date, "
        f"CAST(CAST(max({p}) AS DATE) AS VARCHAR) AS max_date, "
        f"CAST(floor(epoch(max({p}) - min({p})) / 86400) AS BIGINT) AS date_range_days FROM dq"
        for c, p in parsed.items()
    )
    event_profile = union(
        f"SELECT '{c}' AS \"Column\", {pct(f'(count(*) - count({c}))', 'count(*)')} AS \"Null %\", "
        f"count(DISTINCT {c}) AS \"Unique\", {half_up(f'count(DISTINCT {c}) / count(*)')} AS \"Cardinality\", "
        + (
            f"round(avg({c}), 4) AS \"Mean\", round(stddev_samp({c}), 4) AS \"Std\", round(skewness({c}), 4) AS \"Skewness\""
            if c in ("event_id", "user_id", "value")
            else "NULL::DOUBLE AS \"Mean\", NULL::DOUBLE AS \"Std\", NULL::DOUBLE AS \"Skewness\""
        )
        + " FROM events"
        for c in column_kinds["events"]
    )
    answers = {
        "column_nulls": over_dq(
            "SELECT \"column\", null_count, null_pct, round(100 - null_pct, 2) AS score, "
            "CASE WHEN null_pct >= 50 THEN 'critical' WHEN null_pct >= 20 THEN 'warning' ELSE 'ok' END AS severity "
            f"FROM ({null_pct})"
        ),
        "bad_rows": over_dq(
            "SELECT count(*) AS row_count, count_if(bad) AS bad_row_count, "
            f"{pct('count_if(bad)', 'count(*)')} AS bad_row_pct FROM (SELECT "
            f"({' + '.join(f'CAST({c} IS NULL AS INT)' for c in names)}) * 2 > {len(names)} AS bad FROM dq)"
        ),
        "numeric_profile": lineitem_profile,
        "median_profile": union(
            f"SELECT '{c}' AS \"column\", {nearest(f'median({c})', 4)} AS median FROM lineitem"
            for c in LINEITEM
        ),
        "median_sketches": union(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, TRUE AS near FROM lineitem" for c in LINEITEM
        ),
        "skew_kurtosis": union(
            f"SELECT '{c}' AS \"column\", round(skewness({c}), 4) + 0.0 AS skewness, round(kurtosis({c}), 4) + 0.0 AS kurtosis FROM events"
            for c in ("event_id", "user_id", "value")
        ),
        "correlation_matrix": matrix,
        "correlated_pairs": over_dq(
            "SELECT 'revenue' AS \"column\", 'sales' AS other, round(abs(r), 3) AS r "
            "FROM (SELECT corr(sales, sales * 1.0001) AS r FROM dq) WHERE abs(r) >= 0.95 UNION ALL "
            + union(
                f"SELECT '{a}', '{b}', round(abs(r), 3) FROM (SELECT corr({x}, {y}) AS r FROM dq) WHERE abs(r) >= 0.95"
                for a, x, b, y in (
                    ("sales", "sales", "quantity", "quantity"),
                    ("discount_rate", "discount_rate", "quantity", "quantity"),
                    ("discount_rate", "discount_rate", "sales", "sales"),
                    ("revenue", "sales * 1.0001", "quantity", "quantity"),
                    ("revenue", "sales * 1.0001", "discount_rate", "discount_rate"),
                )
            )
        ),
        "distinct_counts": distinct,
        "top_values": union(
            [
                frequent("events", "event_type"),
                frequent("events", "ts"),
                frequent("events", "props"),
                frequent("documents", "text"),
                frequent("documents", "lang"),
                frequent("documents", "source"),
            ]
        ),
        "sample_values": union(
            ranked("orders", c, c, 3)
            for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
        ),
        "missing_map": over_dq(f"SELECT \"column\", null_pct FROM ({null_pct})"),
        "top_missing": over_dq(
            "SELECT \"column\", null_count, null_pct, CASE WHEN null_pct >= 50 THEN 'Critical' "
            f"WHEN null_pct >= 20 THEN 'Warning' ELSE 'OK' END AS status FROM ({null_pct}) WHERE null_pct > 0 "
            "ORDER BY null_pct DESC, ordinal LIMIT 30"
        ),
        "duplicate_rows": (
            "SELECT count(*) AS row_count, count(DISTINCT (user_id, event_type)) AS distinct_rows, "
            "count(*) - count(DISTINCT (user_id, event_type)) AS duplicate_rows FROM events"
        ),
        "duplicate_count": over_dq(
            "SELECT (SELECT n FROM size) - count(*) AS duplicate_rows FROM "
            "(SELECT DISTINCT * FROM dq)"
        ),
        "id_nulls": violations(ids),
        "range_violations": violations(ranges),
        "enum_violations": violations(enums),
        "enum_samples": over_dq(
            union(
                f"(SELECT '{c}' AS \"column\", value FROM (SELECT DISTINCT trim(CAST({c} AS VARCHAR)) AS value "
                f"FROM dq WHERE {test}) ORDER BY value LIMIT 5)"
                for c, test in enums.items()
            )
        ),
        "datetime_parse_failures": violations(parses),
        "rule_violations": over_dq(all_violations),
        "date_window": over_dq(windows),
        "date_gaps": over_dq(
            union(
                f"SELECT '{c}' AS \"column\", CAST(({gaps[c]}) AS INT) AS max_gap_days" for c in DATES
            )
        ),
        "day_gaps": (
            "SELECT 'ts' AS \"column\", CAST(day AS VARCHAR) AS day, "
            "CAST(date_diff('day', lag(day) OVER (ORDER BY day), day) AS INT) AS gap_days "
            "FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
        ),
        "zscore_outliers": zscores("events", ("event_id", "user_id", "value")),
        "zscore_outliers_dq": over_dq(zscores("dq", DQ_NUMBERS)),
        "feature_spread": spread,
        "class_counts": "SELECT toxic AS value, count(*) AS n FROM labels GROUP BY toxic",
        "class_balance": (
            "SELECT count(*) AS class_count, min(n) AS minority_count, CAST(sum(n) AS BIGINT) AS row_count, "
            f"{half_up('min(n) / sum(n)')} AS minority_class_ratio FROM "
            "(SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)"
        ),
        "classify_columns": classes,
        "dataset_summary": over_dq(
            f"SELECT count(*) AS row_count, {len(names)}::BIGINT AS column_count, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dq)) AS duplicate_row_count, "
            f"CAST(sum({gap_sum}) AS BIGINT) AS total_missing_cells, "
            f"{pct(f'sum({gap_sum})', f'(count(*) * {len(names)})')} AS missing_cell_pct FROM dq"
        ),
        "column_table": event_profile,
        "scorecard": over_dq(scored),
        "score_table": over_dq(
            f"SELECT {label} AS \"Pillar\", printf('%.0f%%', weight * 100) AS \"Weight\", "
            "printf('%.1f', score) AS \"Score\", printf('%.2f', weighted_score) AS \"Weighted\", "
            "printf('%d/%d', passed_checks, total_checks) AS \"Checks Passed\", "
            f"{status('score')} AS \"Status\" FROM ({scored}) UNION ALL "
            "SELECT '**OVERALL**', '100%', printf('%.1f', overall_score), printf('%.2f', overall_score), '', "
            f"{status('overall_score')} FROM ({overall})"
        ),
        "quality_band": over_dq(
            "SELECT overall_score, "
            "CASE WHEN overall_score >= 85 THEN 'excellent' WHEN overall_score >= 70 THEN 'good' "
            "WHEN overall_score >= 50 THEN 'at_risk' ELSE 'not_ready' END AS band, "
            "CASE WHEN overall_score >= 85 THEN 'Excellent — Ready for ML' "
            "WHEN overall_score >= 70 THEN 'Good — Minor fixes needed' "
            "WHEN overall_score >= 50 THEN 'At Risk — Significant remediation required' "
            "ELSE 'Not Ready — Not suitable for AI' END AS band_label, "
            "CASE WHEN overall_score >= 85 THEN '#2ecc71' WHEN overall_score >= 70 THEN '#f39c12' "
            f"WHEN overall_score >= 50 THEN '#e67e22' ELSE '#e74c3c' END AS band_color FROM ({overall})"
        ),
        "issues": over_dq(issues),
        "recommendations": over_dq(recommendations),
        "table_sizes": union(
            f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({w} AS BIGINT) AS column_count, "
            f"{nearest(f'CAST(sum({size}) AS BIGINT) / 1048576')} AS size_mb, CAST({n} AS BIGINT) AS numeric_columns, "
            f"CAST({c} AS BIGINT) AS text_columns, CAST({d} AS BIGINT) AS date_columns FROM {t}"
            for t, w, n, c, d, size in (
                ("labels", 3, 3, 0, 0, "24"),
                ("documents", 5, 2, 3, 0, "16 + " + " + ".join(f"coalesce(strlen({c}), 0)" for c in ("text", "lang", "source"))),
                ("events", 6, 3, 2, 1, "32 + coalesce(strlen(event_type), 0) + coalesce(strlen(props), 0)"),
            )
        ),
        "forest_of_complete_rows": (
            "SELECT count(*) AS sample_size, 0.05::DOUBLE AS contamination, true AS within FROM lineitem "
            "WHERE l_partkey % 5 <> 0 AND l_suppkey % 7 <> 0"
        ),
        "leading_matrix": union(
            f"SELECT 'c{a}' AS row_column, 'c{b}' AS col_column, round(corr({wave(a)}, {wave(b)}), 4) AS r FROM lineitem"
            for a in range(20) for b in range(20)
        ),
        "result_file": over_dq(
            f"SELECT overall_score, pillar, score, passed_checks, total_checks FROM ({scored}), ({overall})"
        ),
        "csv_round_trip": (
            "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
            "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority, "
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders"
        ),
        "json_round_trip": "SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events",
        "preview_count": "SELECT least(count(*), 7) AS n FROM customer",
        "parquet_table": "SELECT * FROM supplier",
        "planted_outliers": (
            "SELECT count_if(l_orderkey % 997 = 0) AS planted, CAST(0 AS BIGINT) AS missed, count(*) AS sample_size FROM lineitem"
        ),
        "many_classes": "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_partkey",
        "wide_bad_rows": (
            "SELECT count(*) AS row_count, count_if(bad) AS bad_row_count, "
            f"{pct('count_if(bad)', 'count(*)')} AS bad_row_pct FROM (SELECT "
            "len(list_filter(range(1, 1501), lambda i: (l_partkey * i) % 11 < 5)) * 2 > 1500 AS bad FROM lineitem)"
        ),
        "slash_dates": union(
            f"SELECT '{c}' AS \"column\", CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS min_date, "
            "CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS max_date, "
            "date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS date_range_days FROM orders"
            for c in (
                "slashes", "slashes_minutes", "slashes_seconds", "year_first", "iso", "month_name", "digits",
                "month_word", "month_first", "dots", "half_days", "year_first_minutes", "short_year",
            )
        ),
    }
    answers |= {f"{p}_score": over_dq(q) for p, q in pillars.items()}
    # the columns found are the configured ones
    answers["auto_dates_score"] = answers["timeliness_score"]
    return answers
