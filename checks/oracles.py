"""The registered queries once more, as plain SQL over the test tables."""

from __future__ import annotations

ROLES = """
seen AS (
  SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_presented
  FROM orders GROUP BY o_custkey),
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS external_id, first_seen, last_presented,
         c_mktsegment AS profile_role, c_mktsegment AS account_type,
         c_acctbal > 4500 AS premium, c_nationkey < 5 AS trial
  FROM customer LEFT JOIN seen ON o_custkey = c_custkey),
lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS teacher, CAST(l_orderkey AS VARCHAR) AS presentation_id,
         CAST(l_partkey AS VARCHAR) AS slide_id, CAST(l_suppkey AS VARCHAR) AS student,
         p_type AS slide_type, p_name AS app, o_orderdate AS ts,
         CAST(o_orderdate AS DATE) AS date, CAST(hour(o_orderdate) AS INTEGER) AS hour
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
launches AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS ts, o_orderpriority AS button,
         CASE o_orderstatus WHEN 'F' THEN 'free' WHEN 'O' THEN 'premium'
                            WHEN 'P' THEN 'premiumTrial' END AS status
  FROM orders),
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS event, ts FROM events),
dict(category, event) AS (
  VALUES ('teacher_event', 'click'), ('teacher_event', 'view'), ('teacher_event', 'purchase'),
         ('student_event', 'view'), ('student_event', 'error'), ('before_session', 'click'),
         ('during_session', 'view'), ('after_session', 'purchase'), ('before_signup', 'signup'),
         ('teacher_event', '1-URGENT'), ('teacher_event', '2-HIGH'),
         ('teacher_event', '3-MEDIUM'), ('student_event', '3-MEDIUM'),
         ('student_event', '4-NOT SPECIFIED'), ('before_session', '1-URGENT'),
         ('during_session', '2-HIGH'), ('during_session', '4-NOT SPECIFIED'),
         ('after_session', '3-MEDIUM'), ('before_signup', '5-LOW')),
statuses AS (
  SELECT *, CASE WHEN NOT premium AND NOT trial THEN 'free'
                 WHEN premium AND NOT trial THEN 'premium'
                 WHEN premium AND trial THEN 'premiumtrial' END AS account_status
  FROM users),
cohort AS (
  SELECT external_id AS teacher, first_seen, CAST(first_seen AS DATE) AS fd
  FROM users
  WHERE CAST(first_seen AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'
    AND profile_role <> 'HOUSEHOLD')
"""


def _plus(day: str, months: int) -> str:
    return f"CAST({day} + INTERVAL {months} MONTH AS DATE)"


def _window(day: str, start: int, stop: int, shift: int) -> str:
    lo, hi = _plus("fd", start), _plus("fd", stop)
    if shift:
        lo, hi = _plus(lo, shift), _plus(hi, shift)
    return f"{day} BETWEEN {lo} AND {hi}"


def _sessions(name: str, shift: int, by_presentation: bool = True) -> str:
    """Sessions of one period, following the nested form: join raw rows, count distinct."""
    inside = _window("date", 0, 12, shift)
    grain = "sp.teacher, sp.presentation_id, sp.date, sp.hour"
    if not by_presentation:
        grain = "sp.teacher, sp.date, sp.hour"
    return f"""{name} AS (
  SELECT {grain}, strftime(sp.date, '%Y-%m') AS year_month,
         count(DISTINCT sp.presentation_id) AS num_presentations,
         count(DISTINCT sr.student) AS num_students, count(sr.student) AS num_responses
  FROM (SELECT lines.* FROM lines JOIN cohort USING (teacher) WHERE {inside}) sp
  LEFT JOIN (SELECT lines.* FROM lines JOIN cohort USING (teacher)
             WHERE {inside} AND app NOT LIKE '%widget%') sr
    ON sp.teacher = sr.teacher AND sp.slide_id = sr.slide_id
   AND sp.presentation_id = sr.presentation_id AND sp.date = sr.date AND sp.hour = sr.hour
  GROUP BY {grain})"""


BUCKETS_5 = {
    "testing": "s <= 1",
    "low": "s BETWEEN 2 AND 3",
    "low_medium": "s BETWEEN 4 AND 5",
    "medium": "s BETWEEN 6 AND 8",
    "high": "s >= 9",
}
BUCKETS_6 = {
    "testing": "s <= 1",
    "low": "s BETWEEN 2 AND 3",
    "low_medium": "s = 4",
    "medium": "s BETWEEN 5 AND 6",
    "medium_high": "s BETWEEN 7 AND 9",
    "high": "s >= 10",
}


def _totals(name: str, sessions: str, buckets: dict[str, str]) -> str:
    counts = "".join(
        f", CAST(count(CASE WHEN {test} THEN 1 END) AS BIGINT) AS n_{b}"
        for b, test in buckets.items()
    )
    return f"""{name} AS (
  SELECT *, CAST(total_responses AS DOUBLE) / nullif(total_presentations, 0)
              AS responses_per_presentation,
         coalesce(CAST(total_responses AS DOUBLE) / nullif(total_students, 0), 0)
              AS responses_per_student,
         (year(last_month) - year(first_month)) * 12 + month(last_month) - month(first_month) + 1
              AS months_spanned,
         (1999 - year(first_month)) * 12 + 6 - month(first_month) + 1 AS months_since_first
  FROM (SELECT teacher, CAST(sum(num_presentations) AS BIGINT) AS total_presentations,
               CAST(sum(num_students) AS BIGINT) AS total_students,
               CAST(sum(num_responses) AS BIGINT) AS total_responses,
               count(DISTINCT year_month) AS months_used,
               CAST(date_trunc('month', min(date)) AS DATE) AS first_month,
               CAST(date_trunc('month', max(date)) AS DATE) AS last_month{counts}
        FROM (SELECT *, num_students AS s FROM {sessions}) GROUP BY teacher))"""


INTENSITY = """
  round_even(CAST(months_used AS DOUBLE) / months_since_first, 2) AS months_used_share,
  round_even(CAST(total_presentations AS DOUBLE) / months_used, 2)
    AS presentations_per_month_used,
  round_even(CAST(total_presentations AS DOUBLE) / months_spanned, 2)
    AS presentations_per_month_spanned,
  round_even(CAST(total_presentations AS DOUBLE) / months_since_first, 2)
    AS presentations_per_month_since"""


def _ends(name: str, shift: int) -> str:
    """First and last launch per member, then the status by joining back to the launches."""
    inside = _window("CAST(ts AS DATE)", 1, 12, shift)
    return f"""{name}_span AS (
  SELECT teacher, min(ts) AS first_launch, max(ts) AS last_launch
  FROM cohort LEFT JOIN launches ON user_id = teacher
  WHERE {inside} OR ts IS NULL GROUP BY teacher),
{name} AS (
  SELECT teacher, any_value(first_launch) AS first_launch, any_value(last_launch) AS last_launch,
         lower(min(CASE WHEN ts = first_launch THEN status END)) AS status_first,
         lower(max(CASE WHEN ts = last_launch THEN status END)) AS status_last
  FROM {name}_span LEFT JOIN launches
    ON user_id = teacher AND (ts = first_launch OR ts = last_launch)
  GROUP BY teacher)"""


SLIDE_COUNTS = f"""slide_counts AS (
  SELECT teacher, slide_type, count(*) AS n
  FROM (SELECT DISTINCT teacher, presentation_id, slide_id, slide_type, date, hour
        FROM lines JOIN cohort USING (teacher) WHERE {_window("date", 0, 12, 0)})
  GROUP BY teacher, slide_type)"""

DIVERSITY = """diversity AS (
  SELECT teacher,
         abs(round_even(-sum(p * ln(p)) / ln((SELECT count(DISTINCT slide_type)
                                              FROM slide_counts)), 3)) AS slide_diversity
  FROM (SELECT teacher, n / sum(n) OVER (PARTITION BY teacher) AS p FROM slide_counts)
  GROUP BY teacher)"""

SPECIAL = f"""special AS (
  SELECT teacher, count(*) AS num_uses, 1 AS special_app_use
  FROM lines JOIN cohort USING (teacher)
  WHERE app LIKE '%widget%' AND {_window("date", 0, 12, 0)} GROUP BY teacher)"""


def _account(recoded: bool) -> str:
    kind = "account_type"
    if recoded:
        kind = "CASE WHEN account_type = 'MACHINERY' THEN 'BUILDING' ELSE account_type END"
    return f"""account AS (
  SELECT external_id AS teacher, account_status AS account_status_later,
         {kind} AS account_type_later
  FROM statuses JOIN cohort ON teacher = external_id)"""


USAGE = """CASE WHEN coalesce(total_presentations, 0) = 0 THEN 'Never Used'
     WHEN total_presentations > 0 AND total_students <= 1 THEN 'Tested Product Only'
     WHEN total_presentations > 0 AND total_students > 1 THEN 'Used Product' ELSE '' END"""
STATUS = """CASE WHEN coalesce(total_presentations, 0) = 0 THEN 'Never Used'
     WHEN total_presentations > 0 AND total_students <= 1 THEN 'Tested Project Only'
     WHEN total_presentations > 0 AND total_students > 1 AND status_last = 'free'
       THEN 'Used Product Free'
     WHEN total_presentations > 0 AND total_students > 1 AND status_last = 'premium'
       THEN 'Used Product Premium'
     WHEN total_presentations > 0 AND total_students > 1 AND status_last = 'premiumtrial'
       THEN 'Used Product PremiumTrial'
     WHEN total_presentations > 0 AND total_students > 1 AND status_last IS NULL
       THEN 'Used Product Unknown Status' ELSE '' END"""
AUDIENCE = """CASE WHEN coalesce(total_presentations - n_testing, 0) = 0 THEN 'None'
     WHEN total_presentations - n_testing BETWEEN 1 AND 9 THEN 'Light'
     WHEN total_presentations - n_testing BETWEEN 10 AND 19 THEN 'Medium'
     WHEN total_presentations - n_testing BETWEEN 20 AND 34 THEN 'Heavy'
     WHEN total_presentations - n_testing >= 35 THEN 'Superuser' END"""


def _mart(name: str, period: str, shift: int, buckets: dict, digits: int | None, extra: str = ""):
    def share(bucket: str) -> str:
        value = f"coalesce(CAST(n_{bucket} AS DOUBLE) / nullif(total_presentations, 0), 0)"
        value = f"round_even({value}, {digits})" if digits is not None else value
        return f"CASE WHEN total_presentations IS NOT NULL THEN {value} END"

    shares = ", ".join(f"{share(b)} AS share_{b}" for b in buckets)
    return ",\n".join(
        [
            _sessions(f"{name}_s", shift),
            _totals(f"{name}_t", f"{name}_s", buckets),
            _ends(f"{name}_e", shift),
            f"""{name} AS (
  SELECT '{period}' AS period, cohort.teacher, cohort.first_seen, slide_diversity,
         coalesce(special_app_use, 0) AS special_app_use, account_status_later,
         account_type_later, coalesce(total_presentations, 0) AS total_presentations,
         total_students, total_responses, months_used, first_month, last_month,
         responses_per_presentation, responses_per_student, {shares},
         1 - {share("testing")} AS share_valid, months_spanned, months_since_first, {INTENSITY},
         status_first, status_last, coalesce(n_testing, 0) AS testing_presentations,
         coalesce(total_presentations - n_testing, 0) AS audience_presentations,
         {AUDIENCE} AS audience_label, {USAGE} AS usage_label{extra}
  FROM cohort LEFT JOIN {name}_t USING (teacher) LEFT JOIN {name}_e USING (teacher)
  LEFT JOIN diversity USING (teacher) LEFT JOIN special USING (teacher)
  LEFT JOIN account USING (teacher))""",
        ]
    )


PARTS = ",\n".join([SLIDE_COUNTS, DIVERSITY, SPECIAL])
INITIAL_MART = _mart("initial", "initial", 0, BUCKETS_5, None)
LATER_MART = _mart("later", "later", 12, BUCKETS_5, None)
CATEGORIES = (
    "teacher_event",
    "student_event",
    "before_session",
    "during_session",
    "after_session",
    "before_signup",
)


def _profile(name: str, inside: str) -> str:
    """Event shares of ``inside`` (teacher, event), by joining rows to the dictionary."""
    sums = ", ".join(f"count(CASE WHEN category = '{c}' THEN 1 END) AS {c}" for c in CATEGORIES)
    total = " + ".join(CATEGORIES)
    shares = ", ".join(
        f"CAST({c} AS DOUBLE) / nullif({total}, 0) AS {c}_prop" for c in CATEGORIES
    )
    return f"""{name} AS (
  SELECT teacher, {shares}
  FROM (SELECT i.teacher, {sums} FROM ({inside}) i LEFT JOIN dict ON dict.event = i.event
        GROUP BY i.teacher))"""


EVENT_INSIDE = """SELECT user_id AS teacher, event FROM ev
  JOIN (SELECT user_id, CAST(min(ts) AS DATE) AS fd FROM ev GROUP BY user_id) USING (user_id)
  WHERE CAST(ts AS DATE) BETWEEN fd AND fd + 14"""
CUSTOMER_INSIDE = f"""SELECT teacher, button AS event FROM launches JOIN cohort ON user_id = teacher
  WHERE {_window("CAST(ts AS DATE)", 0, 12, 0)}"""

PARTICIPATED = """participated AS (
  SELECT t.teacher, first_as_student, first_as_teacher, 1 AS participated_before
  FROM (SELECT teacher, min(ts) AS first_as_teacher FROM lines GROUP BY teacher) t
  JOIN (SELECT student AS teacher, min(ts) AS first_as_student FROM lines GROUP BY student) s
    ON s.teacher = t.teacher
  JOIN (SELECT DISTINCT external_id FROM users WHERE profile_role <> 'HOUSEHOLD') u
    ON u.external_id = t.teacher
  WHERE first_as_student < first_as_teacher)"""

SINCE = "TIMESTAMP '2001-01-01'"
RECENT = f"""recent AS (
  SELECT DISTINCT external_id, account_status, account_type FROM statuses
  WHERE last_presented >= {SINCE} AND account_status IS NOT NULL)"""
FEATURES = f"""counts AS (
  SELECT teacher AS user_id,
         CAST(sum(CASE WHEN slide_type = 'PROMO' THEN 1 ELSE 0 END) AS BIGINT) AS drawing_count,
         CAST(sum(CASE WHEN slide_type = 'LARGE' THEN 1 ELSE 0 END) AS BIGINT) AS draggable_count
  FROM lines WHERE ts >= {SINCE} GROUP BY teacher),
{RECENT},
feature_users AS (
  SELECT user_id, drawing_count, draggable_count, account_status
  FROM counts JOIN recent ON external_id = user_id)"""
CLICKS = """clicks AS (
  SELECT user_id, ts FROM launches
  WHERE button = '1-URGENT' AND ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1995-08-01')"""
ACTIVITY = """activity AS (
  SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month, teacher AS user_id FROM lines)"""
START = "month BETWEEN DATE '1995-01-01' AND DATE '1995-08-01'"
END = "month BETWEEN DATE '1996-01-01' AND DATE '1996-06-01'"
MONTHS = [f"{y}-{m:02d}" for y in (1995, 1996) for m in range(1, 13)]
MONTHS_LONG = f"""months_long AS (
  SELECT teacher, year_month, CAST(coalesce(sum(num_presentations), 0) AS BIGINT)
           AS num_presentations
  FROM (SELECT DISTINCT teacher FROM sessions)
  CROSS JOIN (SELECT unnest({MONTHS!r}) AS year_month)
  LEFT JOIN sessions USING (teacher, year_month) GROUP BY teacher, year_month)"""
LABELLED = f"""labelled AS (
  SELECT cohort.teacher, coalesce(total_presentations, 0) AS total_presentations,
         totals.* EXCLUDE (teacher, total_presentations, months_spanned, months_since_first)
  FROM cohort LEFT JOIN totals USING (teacher))"""
DOCS = """docs AS (
  SELECT labels.doc_id, quality, n_chars,
         CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000.0) AS score
  FROM labels JOIN documents ON documents.doc_id = labels.doc_id)"""
SPLIT_SIZES = """sizes AS (
  SELECT quality, n, CAST(ceil(n * 0.7) AS BIGINT) AS train,
         CAST(ceil((n - ceil(n * 0.7)) * 0.5) AS BIGINT) AS test
  FROM (SELECT quality, count(*) AS n FROM docs GROUP BY quality)),
splits AS (
  SELECT quality, 'train' AS split, train AS total FROM sizes
  UNION ALL SELECT quality, 'test', test FROM sizes
  UNION ALL SELECT quality, 'validation', n - train - test FROM sizes)"""
MONTHS_OF_USERS = """months_of_users AS (
  SELECT DISTINCT teacher AS user_id, CAST(date_trunc('month', date) AS DATE) AS month
  FROM lines WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'),
all_months AS (
  SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE)
    AS month)"""
SWEEP = """sweep AS (
  SELECT cutoff, tp, fp, fn, tn, pos, neg,
         CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
         CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision,
         CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
         CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM (SELECT c.score AS cutoff,
               count(CASE WHEN d.score >= c.score AND quality = 1 THEN 1 END) AS tp,
               count(CASE WHEN d.score >= c.score AND quality = 0 THEN 1 END) AS fp,
               count(CASE WHEN d.score < c.score AND quality = 1 THEN 1 END) AS fn,
               count(CASE WHEN d.score < c.score AND quality = 0 THEN 1 END) AS tn,
               count(CASE WHEN d.score = c.score AND quality = 1 THEN 1 END) AS pos,
               count(CASE WHEN d.score = c.score AND quality = 0 THEN 1 END) AS neg
        FROM (SELECT DISTINCT score FROM docs) c CROSS JOIN docs d GROUP BY c.score))"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ROLES.strip(), *ctes]) + "\n" + body


def _percent(*columns: str) -> str:
    return ", ".join(f"{c} * 100 AS {c}" for c in columns)


SESSIONS = _sessions("sessions", 0)
TOTALS = _totals("totals", "sessions", {})
TOTALS_5 = _totals("totals", "sessions", BUCKETS_5)
TOTALS_6 = _totals("totals", "sessions", BUCKETS_6)
STATS = """CAST(sum(presentations) AS BIGINT) AS total_presentations,
  round_even(avg(presentations), 0) AS presentations_avg,
  round_even(stddev_samp(presentations), 1) AS presentations_sd"""
SHARES_5 = ", ".join(
    f"CAST(n_{b} AS DOUBLE) / total_presentations AS share_{b}" for b in BUCKETS_5
)
SHARES_6 = ", ".join(
    f"round_even(CAST(n_{b} AS DOUBLE) / total_presentations, 2) AS share_{b}" for b in BUCKETS_6
)
LABEL_6 = (
    "CASE "
    + " ".join(
        f"WHEN {test} THEN '{name}'"
        for test, name in zip(
            BUCKETS_6.values(),
            ("Testing", "Low", "Low-Medium", "Medium", "Medium-High", "High"),
        )
    )
    + " END"
)
ORDER_6 = (
    "CASE " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(BUCKETS_6.values())) + " END"
)
CORRELATED = ["total_presentations", "total_students", "months_used", "n_testing", "n_low"]

MODEL_CTES = (
PARTS,
        _account(True),
        INITIAL_MART,
        LATER_MART,
        PARTICIPATED,
        _profile("profile", CUSTOMER_INSIDE),
)
MODEL_TABLE = f"""SELECT i.teacher, i.first_seen, {_percent("slide_diversity")}, special_app_use,
  i.account_type_later, i.total_presentations, coalesce(i.total_students, 0) AS total_students,
  i.total_responses, i.months_used, i.first_month, i.last_month,
  {_percent("responses_per_presentation")}, i.responses_per_student,
  {_percent(*[f"share_{b}" for b in BUCKETS_5], "share_valid")}, i.months_spanned,
  i.months_since_first, i.months_used_share, i.presentations_per_month_used,
  i.presentations_per_month_spanned, i.presentations_per_month_since,
  i.status_last AS subscription_initial, i.testing_presentations, i.audience_presentations,
  i.audience_label, i.usage_label AS usage_label_initial, l.usage_label AS usage_label_later,
  l.subscription AS subscription_later, l.total_presentations AS presentations_later,
  CASE WHEN i.total_presentations > 0 AND i.usage_label <> 'Tested Product Only' THEN 1 ELSE 0 END
    AS used_initial,
  CASE WHEN l.total_presentations > 0 AND l.usage_label <> 'Tested Product Only' THEN 1 ELSE 0 END
    AS used_later,
  CASE WHEN subscription = 'premium' THEN 1 WHEN subscription IS NOT NULL THEN 0 END
    AS premium_later,
  CASE WHEN subscription = 'premiumtrial' THEN 1 WHEN subscription IS NOT NULL THEN 0 END
    AS premiumtrial_later,
  CASE WHEN subscription = 'free' THEN 1 WHEN subscription IS NOT NULL THEN 0 END AS free_later,
  coalesce(participated_before, 0) AS participated_before,
  {_percent(*[f"{c}_prop" for c in CATEGORIES])}
FROM initial i
JOIN (SELECT teacher, usage_label, total_presentations,
     coalesce(status_last, account_status_later) AS subscription FROM later) l
  USING (teacher)
LEFT JOIN participated USING (teacher) LEFT JOIN profile USING (teacher)"""
SCREENED = [
    "total_presentations",
    "responses_per_student",
    "share_testing",
    "share_low",
    "share_low_medium",
    "share_medium",
    "share_high",
    "slide_diversity",
    "teacher_event_prop",
    "student_event_prop",
    "before_session_prop",
    "during_session_prop",
    "after_session_prop",
]

def _preset_terms() -> list[tuple[str, str, list[tuple[str, str]]]]:
    """Each model's name, the rows it takes, and its terms with their SQL."""
    numbers = [*SCREENED[:7], "slide_diversity", "special_app_use", "used_initial", "participated_before", *SCREENED[8:]]
    outcomes = ["presentations_later", "used_later", "free_later", "premium_later", "premiumtrial_later"]
    audience = [(f"audience_label_{b}", f"(audience_label = '{b}')") for b in ("None", "Light", "Medium", "Heavy", "Superuser")]
    usage = [
        (f"usage_label_initial_{b}", f"(usage_label_initial = '{b}')")
        for b in ("Never Used", "Tested Product Only", "Used Product")
    ]
    shares = ["share_high", "after_session_prop", "teacher_event_prop", "student_event_prop"]
    used = "usage_label_initial = 'Used Product'"
    ever = "usage_label_initial <> 'Never Used'"
    plain = "premiumtrial_later <> 1"
    models = [
        ("used_later", "used_later", f"{plain} AND {used}", [*shares, "used_initial", "audience_label_Light"]),
        ("presentations_later", "presentations_later", f"{plain} AND {ever} AND usage_label_later <> 'Tested Product Only'",
         ["share_high", "after_session_prop", "usage_label_initial_Used Product",
          "usage_label_initial_Tested Product Only", "audience_label_None"]),
        ("free_later", "free_later", f"{plain} AND {used}", [*shares, "share_testing", "used_initial", "audience_label_Light"]),
        ("premium_later", "premium_later", f"{plain} AND {used}", [*shares, "share_testing", "used_initial", "audience_label_Light"]),
        ("premiumtrial_later", "premiumtrial_later", used, ["used_initial", "audience_label_Light"]),
        ("clusters", None, f"{plain} AND {ever}", []),
    ]
    found = []
    for name, label, rows, gone in models:
        terms = [(n, n) for n in numbers] + audience
        terms += usage if "used_initial" not in gone else []
        terms += [(o, o) for o in outcomes] if label is None else [("label", label)]
        found.append((name, rows, [t for t in terms if t[0] not in gone]))
    return found


ORACLES: dict[str, str] = {
    "scan_limit_sample": _with(
        """SELECT user_id, event AS event_name, ts AS "timestamp" FROM ev
WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts, user_id LIMIT 500"""
    ),
    "filters_basic": _with(
        """SELECT app, count(*) AS num_rows,
  count(CASE WHEN CAST(student AS INTEGER) < 50 THEN 1 END) AS low_students
FROM lines
WHERE app LIKE '%widget%' AND lower(app) NOT LIKE '%red%' AND teacher <> student
  AND slide_id IS NOT NULL AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1999-01-01'
  AND date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'
GROUP BY app"""
    ),
    "recode_fill_scale": _with(
        """SELECT s.external_id,
  CASE WHEN account_type = 'MACHINERY' THEN 'BUILDING' ELSE account_type END AS account_type,
  coalesce(account_status, account_type) AS subscription,
  CASE WHEN account_status = 'premium' THEN 1 WHEN account_status <> 'premium' THEN 0 END
    AS is_premium,
  nullif(profile_role, 'BUILDING') AS role_or_null,
  coalesce(n, 0) * CAST(100 AS DOUBLE) AS premium_launches,
  CASE WHEN n IS NULL THEN 0 ELSE 1 END AS often_premium
FROM statuses s LEFT JOIN (
  SELECT user_id, count(*) AS n FROM launches WHERE status = 'premium'
  GROUP BY user_id HAVING count(*) >= 4) l ON l.user_id = s.external_id
WHERE account_type <> 'FURNITURE'"""
    ),
    "scalar_dates": _with(
        f"""SELECT user_id, ts AS "timestamp", day, CAST(hour(ts) AS INTEGER) AS hour,
  {_plus("day", 3)} AS plus_3, {_plus(_plus("day", 3), 12)} AS plus_3_12,
  CAST(date_trunc('month', day) AS DATE) AS month, strftime(day, '%Y-%m') AS year_month,
  CAST(strftime(day, '%Y-%m') || '-01' AS DATE) AS month_of_text,
  CAST((1999 - year(day)) * 12 + 6 - month(day) + 1 AS INTEGER) AS months_to_day,
  CAST(year(day) * 100 + weekofyear(day) AS INTEGER) AS week_key,
  CAST(isoyear(day) * 100 + weekofyear(day) AS INTEGER) AS iso_week_key
FROM (SELECT *, CAST(ts AS DATE) AS day FROM launches)"""
    ),
    "scalar_text": """SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS lowered,
  substr(c_name, 10, 9) AS number, 'num_' || substr(c_name, 1, 8) AS prefixed,
  replace(c_name, '#', '') AS cleaned,
  nullif((CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE '' END)
      || (CASE WHEN c_nationkey < 10 THEN 'near' ELSE '' END), '') AS united
FROM customer""",
    "scalar_numeric": """SELECT CAST(c_custkey AS VARCHAR) AS id,
  CAST(c_nationkey AS DOUBLE) / nullif(c_custkey - 10, 0) AS guarded,
  CAST(0 AS DOUBLE) AS zero,
  round_even(CAST(c_nationkey AS DOUBLE) / 8, 2) AS rounded,
  round(ln(c_nationkey + 1) / ln(6), 6) AS log_6,
  round(exp(CAST(c_nationkey AS DOUBLE) / 25), 6) AS odds,
  round(sqrt(abs(c_acctbal)), 6) AS root,
  round(pow(c_acctbal / 1000, 2), 6) AS square,
  1 - CAST(c_nationkey AS DOUBLE) / 25 AS complement
FROM customer""",
    "first_last_event": _with(
        """SELECT user_id, CAST(ts AS DATE) AS date, min(ts) AS first_event, max(ts) AS last_event,
  CAST(min(hour(ts)) AS INTEGER) AS first_hour, count(DISTINCT hour(ts)) AS hours
FROM ev GROUP BY user_id, CAST(ts AS DATE)"""
    ),
    "group_totals": _with(
        """SELECT slide_type, count(*) AS rows, count(n) AS known,
  CAST(sum(n) AS BIGINT) AS slides, count(DISTINCT teacher) AS teachers, max(n) AS most
FROM slide_counts GROUP BY slide_type""",
        SLIDE_COUNTS,
    ),
    "status_rows_widened": _with(
        f"""SELECT teacher, max(CASE WHEN rn = 1 THEN ts END) AS timestamp_1,
  max(CASE WHEN rn = 2 THEN ts END) AS timestamp_2,
  max(CASE WHEN rn = 1 THEN smin END) AS account_status_min_1,
  max(CASE WHEN rn = 2 THEN smin END) AS account_status_min_2,
  max(CASE WHEN rn = 1 THEN smax END) AS account_status_max_1,
  max(CASE WHEN rn = 2 THEN smax END) AS account_status_max_2,
  count(*) AS rows_in_group
FROM (
  SELECT *, row_number() OVER (PARTITION BY teacher
           ORDER BY ts, smin NULLS FIRST, smax NULLS FIRST) AS rn
  FROM (SELECT DISTINCT i.teacher, i.ts, CASE WHEN i.ts = lo THEN i.status END AS smin,
               CASE WHEN i.ts = hi THEN i.status END AS smax
        FROM inside i JOIN (SELECT teacher, min(ts) AS lo, max(ts) AS hi
                            FROM inside GROUP BY teacher) e ON e.teacher = i.teacher
        WHERE i.ts = lo OR i.ts = hi)) GROUP BY teacher""",
        f"""inside AS (
  SELECT teacher, ts, status FROM launches JOIN cohort ON user_id = teacher
  WHERE {_window("CAST(ts AS DATE)", 1, 12, 0)})""",
    ),
    "rownumber_widen": _with(
        f"""SELECT teacher, CAST(rn AS INTEGER) AS position, ts AS timestamp, smin AS account_status_min,
  smax AS account_status_max
FROM (
  SELECT *, row_number() OVER (PARTITION BY teacher
           ORDER BY ts, smin NULLS FIRST, smax NULLS FIRST) AS rn
  FROM (SELECT DISTINCT i.teacher, i.ts, CASE WHEN i.ts = lo THEN i.status END AS smin,
               CASE WHEN i.ts = hi THEN i.status END AS smax
        FROM inside i JOIN (SELECT teacher, min(ts) AS lo, max(ts) AS hi
                            FROM inside GROUP BY teacher) e ON e.teacher = i.teacher
        WHERE i.ts = lo OR i.ts = hi))""",
        f"""inside AS (
  SELECT teacher, ts, status FROM launches JOIN cohort ON user_id = teacher
  WHERE {_window("CAST(ts AS DATE)", 1, 12, 0)})""",
    ),
    "left_assembly": _with(
        """SELECT cohort.teacher, first_seen, slides, premium_launches
FROM cohort LEFT JOIN (SELECT teacher, count(*) AS slides FROM lines GROUP BY teacher) a
  USING (teacher)
LEFT JOIN (SELECT user_id AS teacher, count(*) AS premium_launches FROM launches
           WHERE status = 'premium' GROUP BY user_id) b USING (teacher)"""
    ),
    "account_status": _with(
        """SELECT external_id, profile_role, account_type, account_status,
  CASE WHEN NOT premium AND NOT trial THEN 'free' WHEN premium AND trial THEN 'premiumtrial' END
    AS lenient_status
FROM statuses"""
    ),
    "feature_nonusers_by_status": _with(
        """SELECT account_status, count(DISTINCT user_id) AS num_users FROM feature_users
WHERE drawing_count = 0 AND draggable_count = 0 GROUP BY account_status""",
        FEATURES,
    ),
    "feature_sums_by_status": _with(
        """SELECT account_status, CAST(sum(drawing_count) AS BIGINT) AS sum_drawing_count,
  CAST(sum(draggable_count) AS BIGINT) AS sum_draggable_count, 'neither' AS used
FROM feature_users WHERE drawing_count = 0 AND draggable_count = 0 GROUP BY account_status
UNION ALL
SELECT account_status, CAST(sum(drawing_count) AS BIGINT),
  CAST(sum(draggable_count) AS BIGINT), 'all'
FROM feature_users WHERE drawing_count <> 0 AND draggable_count <> 0 GROUP BY account_status""",
        FEATURES,
    ),
    "feature_both_users": _with(
        "SELECT * FROM feature_users WHERE drawing_count <> 0 AND draggable_count <> 0", FEATURES
    ),
    "adopters_with_status": _with(
        """SELECT external_id, account_status, account_type, ts AS "timestamp"
FROM recent LEFT JOIN clicks ON user_id = external_id WHERE user_id IS NOT NULL""",
        RECENT,
        CLICKS,
    ),
    "nonadopters_by_status": _with(
        """SELECT account_status, count(DISTINCT external_id) AS distinct_users
FROM recent LEFT JOIN clicks ON user_id = external_id WHERE user_id IS NULL
GROUP BY account_status ORDER BY account_status""",
        RECENT,
        CLICKS,
    ),
    "participated_before_presenting": _with("SELECT * FROM participated", PARTICIPATED),
    "monthly_activity": _with("SELECT * FROM activity", ACTIVITY),
    "active_with_min_presentations": _with(
        f"""SELECT user_id, month, num_presentations FROM activity JOIN (
  SELECT teacher AS user_id, count(DISTINCT presentation_id) AS num_presentations FROM lines
  WHERE ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1995-08-01'
  GROUP BY teacher HAVING count(DISTINCT presentation_id) > 1) USING (user_id)
WHERE {START}""",
        ACTIVITY,
    ),
    "churn_retention": _with(
        """SELECT CAST(n_churn AS DOUBLE) / nullif(n_start, 0) AS churn_rate,
  1.0 - CAST(n_churn AS DOUBLE) / nullif(n_start, 0) AS retention_rate, n_start, n_end, n_churn
FROM (SELECT count(DISTINCT user_id) AS n_start FROM started),
     (SELECT count(DISTINCT user_id) AS n_end FROM ended),
     (SELECT count(DISTINCT s.user_id) AS n_churn FROM started s LEFT JOIN ended e
        ON e.user_id = s.user_id WHERE e.user_id IS NULL)""",
        ACTIVITY,
        CLICKS,
        f"started AS (SELECT user_id FROM activity JOIN clicks USING (user_id) WHERE {START})",
        f"ended AS (SELECT user_id FROM activity WHERE {END})",
    ),
    "churn_of_spans": _with(
        """SELECT span, CAST(n_churn AS DOUBLE) / nullif(n_start, 0) AS churn_rate,
  1.0 - CAST(n_churn AS DOUBLE) / nullif(n_start, 0) AS retention_rate, n_start, n_end, n_churn
FROM (SELECT span, count(DISTINCT CASE WHEN early AND clicked THEN user_id END) AS n_start,
             count(DISTINCT CASE WHEN late THEN user_id END) AS n_end,
             count(DISTINCT CASE WHEN early AND clicked AND NOT late THEN user_id END) AS n_churn
      FROM (SELECT span, user_id, bool_or(month BETWEEN s1 AND s2) AS early,
                   bool_or(month BETWEEN e1 AND e2) AS late,
                   user_id IN (SELECT user_id FROM clicks) AS clicked
            FROM months_of_users CROSS JOIN spans GROUP BY span, user_id) GROUP BY span)""",
        MONTHS_OF_USERS,
        CLICKS,
        """spans(span, s1, s2, e1, e2) AS (
  VALUES ('published', DATE '1995-01-01', DATE '1995-08-01', DATE '1996-01-01', DATE '1996-06-01'),
    ('year_on_year', DATE '1995-01-01', DATE '1995-12-01', DATE '1996-01-01', DATE '1996-12-01'),
    ('one_month', DATE '1996-03-01', DATE '1996-03-01', DATE '1997-03-01', DATE '1997-03-01'))""",
    ),
    "retention_matrix": _with(
        """SELECT s.month AS start_month, m.month, s.n AS n_users, count(DISTINCT b.user_id) AS n_active,
  CAST(count(DISTINCT b.user_id) AS DOUBLE) / s.n AS share
FROM (SELECT month, count(*) AS n FROM months_of_users GROUP BY month) s
JOIN all_months m ON m.month >= s.month
JOIN months_of_users a ON a.month = s.month
LEFT JOIN months_of_users b ON b.user_id = a.user_id AND b.month = m.month
GROUP BY s.month, m.month, s.n""",
        MONTHS_OF_USERS,
    ),
    "cohort_matrix": _with(
        """SELECT f.cohort_month, m.month, n AS n_users, count(b.user_id) AS n_active,
  CAST(count(b.user_id) AS DOUBLE) / n AS share
FROM (SELECT *, count(*) OVER (PARTITION BY cohort_month) AS n
      FROM (SELECT user_id, min(month) AS cohort_month FROM months_of_users GROUP BY user_id)) f
JOIN all_months m ON m.month >= f.cohort_month
LEFT JOIN months_of_users b ON b.user_id = f.user_id AND b.month = m.month
GROUP BY f.cohort_month, m.month, n""",
        MONTHS_OF_USERS,
    ),
    "distinct_users_by_period": _with(
        " UNION ALL ".join(
            f"""SELECT status AS account_status, '{level}' AS level, {key} AS period,
  count(DISTINCT user_id) AS n_distinct FROM launches GROUP BY ALL"""
            for level, key in (
                ("month", "strftime(ts, '%Y-%m')"),
                ("quarter", "year(ts) || '-' || quarter(ts)"),
                ("year", "CAST(year(ts) AS VARCHAR)"),
                ("total", "'all'"),
            )
        )
    ),
    "cohort_members": _with("SELECT teacher, first_seen FROM cohort"),
    "first_last_status_initial": _with(
        "SELECT 'initial' AS period, * FROM ends", _ends("ends", 0)
    ),
    "first_last_status_later": _with("SELECT 'later' AS period, * FROM ends", _ends("ends", 12)),
    "sessions_initial": _with("SELECT 'initial' AS period, * FROM sessions", SESSIONS),
    "sessions_stored": _with("SELECT 'initial' AS period, * FROM sessions", SESSIONS),
    "sessions_later": _with(
        "SELECT 'later' AS period, * FROM sessions", _sessions("sessions", 12, False)
    ),
    "sessions_excluding_recent": _with(
        """SELECT sp.teacher, sp.date, sp.hour,
  count(DISTINCT sp.presentation_id) AS num_presentations,
  count(DISTINCT sr.student) AS num_students
FROM (SELECT * FROM lines WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
        AND teacher NOT IN (SELECT external_id FROM users
                            WHERE CAST(first_seen AS DATE) >= DATE '1996-01-01')) sp
LEFT JOIN (SELECT * FROM lines WHERE app NOT LIKE '%widget%'
             AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
             AND teacher NOT IN (SELECT external_id FROM users
                                 WHERE CAST(first_seen AS DATE) >= DATE '1996-01-01')) sr
  ON sp.slide_id = sr.slide_id AND sp.presentation_id = sr.presentation_id
 AND sp.date = sr.date AND sp.hour = sr.hour
GROUP BY sp.teacher, sp.date, sp.hour"""
    ),
    "user_facts_of_responders": _with(
        """SELECT DISTINCT external_id, profile_role, first_seen, account_type
FROM users JOIN lines ON teacher = external_id
WHERE first_seen < TIMESTAMP '1996-01-01' AND lower(app) NOT LIKE '%widget%'
  AND date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"""
    ),
    "slide_type_counts": _with(
        """SELECT 'initial' AS period, teacher, slide_type, n AS slide_type_count
FROM slide_counts""",
        SLIDE_COUNTS,
    ),
    "slide_type_shares_wide": _with(
        "SELECT teacher, CAST(sum(n) AS BIGINT) AS total, "
        + ", ".join(
            f"CAST(sum(CASE WHEN slide_type = '{t}' THEN n END) AS DOUBLE) / sum(n) "
            f"AS share_{t.lower()}"
            for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
        )
        + " FROM slide_counts GROUP BY teacher",
        SLIDE_COUNTS,
    ),
    "special_app_flag": _with(
        """SELECT cohort.teacher, coalesce(num_uses, 0) AS num_uses,
  coalesce(special_app_use, 0) AS special_app_use FROM cohort LEFT JOIN special USING (teacher)""",
        SPECIAL,
    ),
    "account_later": _with(
        """SELECT external_id AS teacher,
  CASE WHEN NOT premium AND (NOT trial OR trial IS NULL) THEN 'free'
       ELSE account_status END AS account_status_later,
  CASE WHEN account_type = 'MACHINERY' THEN 'BUILDING' ELSE account_type END
    AS account_type_later
FROM statuses JOIN cohort ON teacher = external_id"""
    ),
    "event_profile": _with("SELECT * FROM profile", _profile("profile", EVENT_INSIDE)),
    "excluded_ids_removed": _with(
        """SELECT teacher, first_seen FROM cohort
WHERE teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""
    ),
    "exclusion_file_read": _with(
        """SELECT teacher, first_seen FROM cohort
WHERE teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""
    ),
    "presentations_by_month_wide": _with(
        "SELECT teacher, "
        + ", ".join(
            f"CAST(sum(CASE WHEN year_month = '{m}' THEN num_presentations ELSE 0 END) AS BIGINT)"
            f' AS "{m}"'
            for m in MONTHS
        )
        + " FROM sessions GROUP BY teacher",
        SESSIONS,
    ),
    "presentations_by_month_long": _with("SELECT * FROM months_long", SESSIONS, MONTHS_LONG),
    "low_engagement_counts": _with(
        """SELECT before AS teachers_before, after AS teachers_after,
  before - after AS teachers_removed
FROM (SELECT count(DISTINCT teacher) AS before FROM sessions),
     (SELECT count(DISTINCT teacher) AS after FROM sessions WHERE num_students > 4)""",
        SESSIONS,
    ),
    "bucket_shares_5": _with(
        f"""SELECT teacher, {SHARES_5},
  1 - CAST(n_testing AS DOUBLE) / total_presentations AS share_valid FROM totals""",
        SESSIONS,
        TOTALS_5,
    ),
    "bucket_shares_6": _with(f"SELECT teacher, {SHARES_6} FROM totals", SESSIONS, TOTALS_6),
    "teacher_totals": _with(
        "SELECT * EXCLUDE (months_spanned, months_since_first) FROM totals", SESSIONS, TOTALS
    ),
    "usage_span_intensity": _with(
        f"""SELECT teacher, first_month, last_month, CAST(months_spanned AS INTEGER)
  AS months_spanned, CAST(months_since_first AS INTEGER) AS months_since_first, {INTENSITY}
FROM totals""",
        SESSIONS,
        TOTALS,
    ),
    "slide_diversity": _with("SELECT * FROM diversity", SLIDE_COUNTS, DIVERSITY),
    "usage_label": _with(
        f"""SELECT cohort.teacher, coalesce(total_presentations, 0) AS total_presentations,
  {USAGE} AS usage_label FROM cohort LEFT JOIN totals USING (teacher)""",
        SESSIONS,
        TOTALS,
    ),
    "status_label": _with(
        f"""SELECT cohort.teacher, {STATUS} AS status_label
FROM cohort LEFT JOIN totals USING (teacher) LEFT JOIN ends USING (teacher)""",
        SESSIONS,
        TOTALS,
        _ends("ends", 0),
    ),
    "audience_label": _with(
        f"""SELECT cohort.teacher,
  coalesce(total_presentations - n_testing, 0) AS audience_presentations,
  coalesce(n_testing, 0) AS testing_presentations, {AUDIENCE} AS audience_label
FROM cohort LEFT JOIN totals USING (teacher)""",
        SESSIONS,
        TOTALS_5,
    ),
    "status_pair_counts": _with(
        """SELECT status_first, status_last, count(*) AS total FROM ends
GROUP BY status_first, status_last""",
        _ends("ends", 0),
    ),
    "feature_mart": _with(
        "SELECT * FROM initial UNION ALL SELECT * FROM later",
        PARTS,
        _account(True),
        INITIAL_MART,
        LATER_MART,
    ),
    "feature_mart_older": _with(
        "SELECT * FROM initial",
        PARTS,
        _account(False),
        _mart("initial", "initial", 0, BUCKETS_6, 2, f", {STATUS} AS status_label"),
    ),
    "model_table": _with(MODEL_TABLE, *MODEL_CTES),
    "correlation_screen": _with(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND "
            f"stddev_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END AS r FROM screened"
            for a in SCREENED
            for b in SCREENED
        ),
        *MODEL_CTES,
        f"""screened AS (
  SELECT * FROM ({MODEL_TABLE})
  WHERE premiumtrial_later IS DISTINCT FROM 1 AND usage_label_initial = 'Used Product'
    AND teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
    AND subscription_later IS NOT NULL AND slide_diversity IS NOT NULL
    AND teacher_event_prop IS NOT NULL)""",
    ),
    "count_by_label": _with(
        f"""SELECT {LABEL_6} AS label, {ORDER_6} AS position, count(*) AS total
FROM (SELECT num_students AS s FROM sessions) GROUP BY 1, 2""",
        SESSIONS,
    ),
    "month_stats_with_zeros": _with(
        f"""SELECT CAST(year_month || '-01' AS DATE) AS month, {STATS}
FROM (SELECT year_month, num_presentations AS presentations FROM months_long)
GROUP BY year_month""",
        SESSIONS,
        MONTHS_LONG,
    ),
    "month_stats_no_zeros": _with(
        f"""SELECT CAST(year_month || '-01' AS DATE) AS month, {STATS}
FROM (SELECT teacher, year_month, sum(num_presentations) AS presentations FROM sessions
      GROUP BY teacher, year_month) GROUP BY year_month""",
        SESSIONS,
    ),
    "week_stats": _with(
        """SELECT CAST(year(date) * 100 + weekofyear(date) AS INTEGER) AS year_week,
  round_even(avg(num_presentations), 0) AS presentations_avg,
  round_even(stddev_samp(num_presentations), 1) AS presentations_sd
FROM sessions GROUP BY 1""",
        _sessions("sessions", 0, False),
    ),
    "histogram": _with(
        """SELECT CAST(num_students AS DOUBLE) AS bin, count(*) AS count, 1 AS width
FROM sessions WHERE num_students BETWEEN 0 AND 10 GROUP BY num_students
UNION ALL
SELECT CAST(5 * ((num_students + 2) // 5) AS DOUBLE), count(*), 5 FROM sessions
GROUP BY (num_students + 2) // 5""",
        SESSIONS,
    ),
    "sessions_of_responses": _with(
        f"""SELECT teacher, date, hour, 'initial' AS period,
  count(DISTINCT presentation_id) AS num_presentations, count(DISTINCT student) AS num_students,
  count(*) AS num_responses
FROM lines JOIN cohort USING (teacher)
WHERE lower(app) NOT LIKE '%widget%' AND {_window("date", 0, 12, 0)}
GROUP BY teacher, date, hour""",
    ),
    "week_stats_per_presentation": _with(
        """SELECT CAST(year(date) * 100 + weekofyear(date) AS INTEGER) AS year_week,
  round_even(avg(num_presentations), 0) AS presentations_avg,
  round_even(stddev_samp(num_presentations), 1) AS presentations_sd
FROM sessions GROUP BY 1""",
        SESSIONS,
    ),
    "scatter_points": _with(
        f"SELECT slide_diversity, presentations_later, usage_label_later FROM ({MODEL_TABLE})",
        *MODEL_CTES,
    ),
    "scatter_sample": _with(
        f"""SELECT slide_diversity, presentations_later, usage_label_later FROM ({MODEL_TABLE})
ORDER BY md5('0:' || teacher), teacher LIMIT 100""",
        *MODEL_CTES,
    ),
    "facet_share_initial": _with(
        f"""SELECT facet, x, n, CAST(sum(n) OVER (PARTITION BY facet) AS BIGINT) AS total,
  CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY facet) AS share
FROM (SELECT usage_label_later AS facet, total_presentations AS x, count(*) AS n FROM ({MODEL_TABLE})
      WHERE usage_label_initial NOT IN ('Never Used', 'Tested Product Only')
      GROUP BY usage_label_later, total_presentations)""",
        *MODEL_CTES,
    ),
    "facet_share": _with(
        """SELECT facet, x, n, CAST(sum(n) OVER (PARTITION BY facet) AS BIGINT) AS total,
  CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY facet) AS share
FROM (SELECT usage_label AS facet, total_presentations AS x, count(*) AS n FROM later
      GROUP BY usage_label, total_presentations)""",
        PARTS,
        _account(True),
        LATER_MART,
    ),
    "missing_cells": _with(
        """SELECT count(*) AS num_rows, CAST(sum("""
        + " + ".join(
            f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"
            for c in (
                "teacher",
                "total_presentations",
                "total_students",
                "total_responses",
                "months_used",
                "first_month",
                "last_month",
                "responses_per_presentation",
                "responses_per_student",
                *[f"n_{b}" for b in BUCKETS_5],
            )
        )
        + """) AS BIGINT) AS missing_cells FROM labelled""",
        SESSIONS,
        TOTALS_5,
        LABELLED,
    ),
    "complete_cases": _with(
        """SELECT teacher, total_presentations, total_students FROM labelled
WHERE total_students IS NOT NULL AND responses_per_presentation IS NOT NULL""",
        SESSIONS,
        TOTALS_5,
        LABELLED,
    ),
    "dummies": _with(
        f"""SELECT teacher, total_presentations,
  {", ".join(f"CASE WHEN {AUDIENCE} = '{b}' THEN 1 ELSE 0 END AS audience_label_{b}" for b in ("Light", "Medium", "Heavy", "Superuser"))},
  coalesce(total_presentations - n_testing, 0) AS label
FROM labelled""",
        SESSIONS,
        TOTALS_5,
        LABELLED,
    ),
    "correlation_long": _with(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND "
            f"stddev_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END AS r FROM kept"
            for a in CORRELATED
            for b in CORRELATED
        ),
        SESSIONS,
        TOTALS_5,
        """kept AS (SELECT * FROM totals
  WHERE teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier))""",
    ),
    "correlation_file": _with(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND "
            f"stddev_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END AS r FROM kept"
            for a in CORRELATED
            for b in CORRELATED
        ),
        SESSIONS,
        TOTALS_5,
        """kept AS (SELECT * FROM totals
  WHERE teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier))""",
    ),
    "stratified_split": _with("SELECT quality, split, total FROM splits", DOCS, SPLIT_SIZES),
    "stratified_split_numeric": """WITH cuts AS (
  SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2,
         quantile_cont(c_acctbal, 0.75) AS q3 FROM customer),
sizes AS (
  SELECT stratum, n, CAST(ceil(n * 0.7) AS BIGINT) AS train,
         CAST(ceil((n - ceil(n * 0.7)) * 0.5) AS BIGINT) AS test
  FROM (SELECT CASE WHEN c_acctbal > q3 THEN 3 WHEN c_acctbal > q2 THEN 2
                    WHEN c_acctbal > q1 THEN 1 ELSE 0 END AS stratum, count(*) AS n
        FROM customer CROSS JOIN cuts GROUP BY 1))
SELECT stratum, 'train' AS split, train AS total FROM sizes
UNION ALL SELECT stratum, 'test', test FROM sizes
UNION ALL SELECT stratum, 'validation', n - train - test FROM sizes""",
    "stratified_split_unknown": _with(
        "SELECT quality, split, total FROM splits",
        DOCS.replace("labels JOIN documents", "documents LEFT JOIN labels").replace("labels.doc_id", "documents.doc_id", 1),
        SPLIT_SIZES,
    ),
    "upsample_unknown": _with(
        """SELECT quality, max(count(*)) OVER () AS rows, count(*) AS documents
FROM docs GROUP BY quality""",
        DOCS.replace("labels JOIN documents", "documents LEFT JOIN labels").replace("labels.doc_id", "documents.doc_id", 1),
    ),
    "class_balance": _with(
        """SELECT part, label, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY part) AS share
FROM (SELECT split AS part, quality AS label, total AS n FROM splits
      UNION ALL SELECT 'all', quality, n FROM sizes)""",
        DOCS,
        SPLIT_SIZES,
    ),
    "upsample": _with(
        """SELECT quality, max(count(*)) OVER () AS rows, count(*) AS documents
FROM docs GROUP BY quality""",
        DOCS,
    ),
    "picked_split": _with("SELECT quality, split, total FROM splits", DOCS, SPLIT_SIZES),
    "linear_line": """SELECT round(regr_slope(c_acctbal, c_nationkey), 3) AS slope,
  round(regr_intercept(c_acctbal, c_nationkey), 1) AS intercept FROM customer""",
    "kmeans_check": """SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS rows, CAST(0 AS BIGINT) AS nearer_to_another,
  true AS closer_than_to_the_mean FROM customer""",
    "preset_columns": _with(
        " UNION ALL ".join(
            f"""SELECT '{preset}' AS preset, '{term}' AS term, count(*) AS rows,
  round(sum(CAST({value} AS DOUBLE)), 4) AS total FROM complete WHERE {rows}"""
            for preset, rows, terms in _preset_terms()
            for term, value in terms
        ),
        *MODEL_CTES,
        f"""complete AS (
  SELECT * FROM ({MODEL_TABLE})
  WHERE teacher NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
    AND subscription_later IS NOT NULL AND slide_diversity IS NOT NULL
    AND teacher_event_prop IS NOT NULL)""",
    ),
    "aliased_columns": """SELECT unnest(['c_nationkey', 'c_custkey', 'affine', 'combined', 'constant', 'near_copy']) AS term,
  unnest([false, regr_r2(c_custkey, c_nationkey) > 1 - 1e-9,
    regr_r2(c_nationkey * 2 - 3, c_nationkey) > 1 - 1e-9,
    (covar_pop(c_custkey / 7 + c_nationkey, c_custkey - c_nationkey * cross_slope)) ** 2
      > (1 - 1e-9) * var_pop(c_custkey - c_nationkey * cross_slope)
        * var_pop(c_custkey / 7 + c_nationkey - c_nationkey * (1 + cross_slope / 7)),
    var_pop(4.0) > 0 OR count(*) > 0, stddev_pop(c_acctbal) = 0]) AS is_aliased
FROM customer, (SELECT regr_slope(c_custkey, c_nationkey) AS cross_slope FROM customer)""",
    "linear_elimination": """WITH r AS (
  SELECT corr(c_acctbal, c_nationkey) AS yn, corr(c_acctbal, c_custkey) AS yc,
         corr(c_nationkey, c_custkey) AS nc, count(*) AS n FROM customer),
partials AS (
  SELECT (yn - yc * nc) / sqrt((1 - yc ** 2) * (1 - nc ** 2)) AS pn,
         (yc - yn * nc) / sqrt((1 - yn ** 2) * (1 - nc ** 2)) AS pc, n FROM r),
sizes AS (
  SELECT abs(pn) * sqrt((n - 3) / (1 - pn ** 2)) AS tn, abs(pc) * sqrt((n - 3) / (1 - pc ** 2)) AS tc FROM partials),
path AS (
  SELECT least(tn, tc) < 1.96 AS one_goes, CASE WHEN tn < tc THEN 'c_nationkey' ELSE 'c_custkey' END AS weaker FROM sizes)
SELECT term, CAST(CASE WHEN one_goes AND term = weaker THEN 1 END AS INTEGER) AS step,
  one_goes AND term = weaker AS dropped
FROM path, (SELECT unnest(['c_nationkey', 'c_custkey']) AS term)""",
    "flag_odds": _with(
        """SELECT term, round(coefficient, 6) AS coefficient, round(exp(coefficient), 6) AS odds_ratio,
  abs(coefficient) > 1.959964 * error AS significant
FROM (SELECT unnest(['odd', '(Intercept)']) AS term,
             unnest([ln(o1 * e0 / (o0 * e1)), ln(e1 / e0)]) AS coefficient,
             unnest([sqrt(1 / o1 + 1 / e0 + 1 / o0 + 1 / e1), sqrt(1 / e1 + 1 / e0)]) AS error
      FROM (SELECT CAST(count(*) FILTER (WHERE n_chars % 2 = 1 AND quality = 1) AS DOUBLE) AS o1,
                   CAST(count(*) FILTER (WHERE n_chars % 2 = 1 AND quality = 0) AS DOUBLE) AS o0,
                   CAST(count(*) FILTER (WHERE n_chars % 2 = 0 AND quality = 1) AS DOUBLE) AS e1,
                   CAST(count(*) FILTER (WHERE n_chars % 2 = 0 AND quality = 0) AS DOUBLE) AS e0
            FROM docs))""",
        DOCS,
    ),
    "flag_scores": _with(
        """SELECT CAST(n_chars % 2 AS DOUBLE) AS odd, count(*) AS rows, round(avg(quality), 8) AS prediction
FROM docs GROUP BY 1""",
        DOCS,
    ),
    "order_statistics": """WITH ordered AS (
  SELECT CAST(n_chars AS DOUBLE) AS v, row_number() OVER (ORDER BY n_chars) - 1 AS place, count(*) OVER () AS n
  FROM documents WHERE n_chars IS NOT NULL)
SELECT chance, round(min(CASE WHEN place = floor((n - 1) * chance) THEN v END)
  + ((n - 1) * chance - floor((n - 1) * chance))
    * (min(CASE WHEN place = ceil((n - 1) * chance) THEN v END) - min(CASE WHEN place = floor((n - 1) * chance) THEN v END)), 6) AS value
FROM ordered, (SELECT unnest(range(21)) / 20.0 AS chance) GROUP BY chance, n""",
    "inflation_of_two": """SELECT unnest(['c_nationkey', 'c_custkey']) AS term,
  round(1 / (1 - corr(c_nationkey, c_custkey) ** 2), 6) AS vif, false AS is_aliased
FROM customer""",
    "logit_score_equations": """SELECT unnest(['log_chars', 'chars_mod_7', '(Intercept)']) AS term,
  count(*) > 0 AS is_zero FROM labels""",
    "cutoff_sweep": _with("SELECT *, CAST(0 AS BIGINT) AS unscored FROM sweep", DOCS, SWEEP),
    "best_cutoff": _with(
        "SELECT *, CAST(0 AS BIGINT) AS unscored FROM sweep ORDER BY f1 DESC, cutoff DESC LIMIT 1", DOCS, SWEEP
    ),
    "auc": _with(
        """SELECT (sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5
                 ELSE 0.0 END)) / count(*) AS auc,
  count(DISTINCT p.doc_id) AS positives, count(DISTINCT n.doc_id) AS negatives
FROM (SELECT * FROM docs WHERE quality = 1) p CROSS JOIN (SELECT * FROM docs WHERE quality = 0) n""",
        DOCS,
    ),
}
