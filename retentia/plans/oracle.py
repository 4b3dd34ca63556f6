"""DuckDB twins of the named queries.

Each string runs on DuckDB with the driver tables registered as views.  They
restate the semantics independently: the feature table here is assembled the
way the original does it (per-feature branches joined on the user),
not as the two-stage aggregate the Spark plan uses.
"""

from __future__ import annotations

# The activity log over events x customer x nation (same rules as
# retentia.sources.activity).
ACTIVITY = """
activity AS (
  SELECT
    CASE WHEN e.event_id % 97 = 0 THEN ''
         WHEN e.event_id % 101 = 0 THEN NULL
         ELSE CAST(e.user_id AS VARCHAR) END AS userId,
    CASE WHEN e.event_type = 'error' THEN
              CASE WHEN e.value > 200 THEN 'Cancellation Confirmation' ELSE 'Error' END
         WHEN e.event_type = 'click' THEN CASE WHEN e.user_id % 23 = 0 THEN 'Help' ELSE 'NextSong' END
         WHEN e.event_type = 'view' THEN CASE WHEN e.user_id % 13 = 0 THEN 'Help' ELSE 'Thumbs Up' END
         WHEN e.event_type = 'purchase' THEN CASE WHEN e.user_id % 17 = 0 THEN 'Help' ELSE 'Thumbs Down' END
         WHEN e.event_type = 'signup' THEN CASE WHEN e.user_id % 11 = 0 THEN 'Help' ELSE 'Add Friend' END END AS page,
    CASE WHEN e.user_id % 7 = 0 THEN CAST(epoch_us(e.ts) // 86400000000 AS BIGINT) * 86400000
         ELSE CAST(epoch_us(e.ts) // 1000 AS BIGINT) END AS ts,
    CASE WHEN e.value >= 35 THEN 'paid' ELSE 'free' END AS level,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'F' WHEN c.c_custkey % 2 = 1 THEN 'M' END AS gender,
    'Metro-' || n.n_name || ', ' || CASE WHEN n.n_nationkey % 5 = 0 THEN 'ZZ-' ELSE '' END
      || chr(CAST(65 + n.n_nationkey AS INTEGER)) || 'X' AS location
  FROM events e
  LEFT JOIN (customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
    ON e.user_id = c.c_custkey
)"""

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def state_sql(loc: str) -> str:
    tail = f"trim(string_split({loc}, ',')[-1], {WS})"
    return (f"CASE WHEN length({tail}) > 2 THEN trim(string_split({tail}, '-')[-1], {WS}) "
            f"ELSE {tail} END")


def date_sql(ts: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor({ts} / 86400000) AS INTEGER))"


def round2_avg(sum_expr: str, cnt_expr: str) -> str:
    """Half-up 2-dp rounding of an average of integers, in exact integer arithmetic."""
    return f"(floor((200 * ({sum_expr}) + ({cnt_expr})) / (2 * ({cnt_expr}))) / 100.0)"


# Cleaned log with derived columns.
CLEAN = f"""
clean AS (
  SELECT userId, page, ts, level, gender, location,
         {date_sql('ts')} AS d,
         {state_sql('location')} AS state,
         CASE WHEN page = 'Cancellation Confirmation' THEN 1 ELSE 0 END AS flag
  FROM activity WHERE userId <> ''
)"""

# Feature-table branches, one per feature, as in the original.
BRANCHES = f"""
users AS (
  SELECT userId, max(flag) AS churn, min(ts) AS first_ts, max(ts) AS last_ts,
         min(d) AS first_d, max(d) AS last_d
  FROM clean GROUP BY userId
),
lastrow AS (
  SELECT userId, gender, level, state FROM (
    SELECT c.userId, c.gender, c.level, c.state,
           row_number() OVER (PARTITION BY c.userId ORDER BY c.level DESC, c.state DESC, c.gender DESC) AS rn
    FROM clean c JOIN users u ON c.userId = u.userId AND c.ts = u.last_ts
    WHERE c.level IS NOT NULL AND c.gender IS NOT NULL AND c.state IS NOT NULL) t
  WHERE rn = 1
),
songs AS (
  SELECT userId, {round2_avg('sum(n)', 'count(*)')} AS avg_songs
  FROM (SELECT userId, d, count(*) AS n FROM clean WHERE page = 'NextSong' GROUP BY userId, d) t
  GROUP BY userId
),
evs AS (
  SELECT userId, {round2_avg('sum(n)', 'count(*)')} AS avg_events
  FROM (SELECT userId, d, count(*) AS n FROM clean GROUP BY userId, d) t
  GROUP BY userId
),
ups AS (SELECT userId, count(*) AS n FROM clean WHERE page = 'Thumbs Up' GROUP BY userId),
downs AS (SELECT userId, count(*) AS n FROM clean WHERE page = 'Thumbs Down' GROUP BY userId),
friends AS (SELECT userId, count(*) AS n FROM clean WHERE page = 'Add Friend' GROUP BY userId),
features AS (
  SELECT u.userId AS userId, l.gender AS gender, CAST(u.churn AS INTEGER) AS churn,
         l.level AS last_level, CAST(date_diff('day', u.first_d, u.last_d) AS INTEGER) AS days_active,
         l.state AS last_state, s.avg_songs AS avg_songs, e.avg_events AS avg_events,
         CAST(coalesce(a.n, 0) AS BIGINT) AS thumbs_up, CAST(coalesce(b.n, 0) AS BIGINT) AS thumbs_down,
         CAST(coalesce(f.n, 0) AS BIGINT) AS addfriend
  FROM users u
  JOIN lastrow l ON u.userId = l.userId
  JOIN songs s ON u.userId = s.userId
  JOIN evs e ON u.userId = e.userId
  LEFT JOIN ups a ON u.userId = a.userId
  LEFT JOIN downs b ON u.userId = b.userId
  LEFT JOIN friends f ON u.userId = f.userId
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


FEATURE_CTES = with_ctes(ACTIVITY, CLEAN, BRANCHES)

FEATURE_COLS = ("userId, gender, churn, last_level, days_active, last_state, avg_songs, avg_events, "
                "thumbs_up, thumbs_down, addfriend")


TEXT_COLS = ("userId", "page", "level", "gender", "location")


def _missing(c: str, text: bool) -> str:
    if text:
        return (f"count(*) FILTER (WHERE contains({c}, 'None') OR contains({c}, 'NULL') OR {c} = '' "
                f"OR {c} IS NULL) AS {c}")
    return f"count(*) FILTER (WHERE {c} IS NULL) AS {c}"


AUDIT = ", ".join(_missing(c, c in TEXT_COLS) for c in ("userId", "page", "ts", "level", "gender", "location"))
LOG_COLS = "userId, page, ts, level, gender, location"
ORDER_ASC = ", ".join(f"{c} ASC NULLS FIRST" for c in ("ts", "userId", "page", "level", "gender", "location"))
ORDER_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in ("ts", "userId", "page", "level", "gender", "location"))
NUMERIC = ("churn", "days_active", "avg_songs", "avg_events", "thumbs_up", "thumbs_down", "addfriend")

# Base of the join form: complete rows at the user's last ts, greatest one kept.
BASE = """
base AS (
  SELECT u.userId AS userId, l.gender AS gender, CAST(u.churn AS INTEGER) AS churn,
         l.level AS last_level, CAST(date_diff('day', u.first_d, u.last_d) AS INTEGER) AS days_active,
         l.state AS last_state
  FROM users u JOIN lastrow l ON u.userId = l.userId
)"""

TOP = """
counts AS (SELECT last_state, count(*) AS cnt FROM features GROUP BY last_state),
ranked AS (SELECT last_state, cnt, row_number() OVER (ORDER BY cnt DESC, last_state ASC NULLS FIRST) AS rnk
           FROM counts)"""


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    act = with_ctes(ACTIVITY)
    cln = with_ctes(ACTIVITY, CLEAN)
    ft = FEATURE_CTES
    q["feature_table"] = f"{ft}\nSELECT {FEATURE_COLS} FROM features"
    q["feature_table_rowlog"] = q["feature_table"]
    q["feature_table_joinform"] = q["feature_table"]
    q["stream_feature_table"] = q["feature_table"]

    # sources and sinks
    q["activity_scan"] = f"{act}\nSELECT {LOG_COLS} FROM activity"
    q["events_json_scan"] = q["activity_scan"]
    q["feature_csv_roundtrip"] = q["feature_table"]
    q["feature_csv_header_scan"] = q["feature_table"]
    q["request_log_append"] = q["feature_table"]

    # profiling
    q["row_count"] = f"{act}\nSELECT count(*) AS n_rows FROM activity"
    q["row_count_clean"] = f"{act}\nSELECT count(*) AS n_rows FROM activity WHERE userId <> ''"
    q["missing_audit"] = f"{act}\nSELECT {AUDIT} FROM activity"
    q["missing_audit_clean"] = f"{act}\nSELECT {AUDIT} FROM activity WHERE userId <> ''"
    q["numeric_describe"] = ft + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS stddev, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM features" for c in NUMERIC)
    q["activity_describe"] = (
        f"{act}\nSELECT 'ts' AS \"column\", count(ts) AS count, round(avg(ts), 0) AS mean, "
        f"round(stddev_samp(ts), 0) AS stddev, round(CAST(min(ts) AS DOUBLE), 0) AS min, "
        f"round(CAST(max(ts) AS DOUBLE), 0) AS max FROM activity")
    q["head_n"] = f"{act}\nSELECT {LOG_COLS} FROM activity ORDER BY {ORDER_ASC} LIMIT 20"
    q["tail_n"] = f"{act}\nSELECT {LOG_COLS} FROM activity ORDER BY {ORDER_DESC} LIMIT 2"

    # filters, labels, row forms
    q["drop_blank_users"] = f"{act}\nSELECT {LOG_COLS} FROM activity WHERE userId <> ''"
    q["churn_event_flag"] = f"{cln}\nSELECT userId, page, ts, flag AS churn FROM clean"
    q["churn_users"] = f"{cln}\nSELECT userId, max(flag) AS churn FROM clean GROUP BY userId"
    q["churn_label_rows"] = (f"{cln}\nSELECT c.userId, c.page, c.ts, u.churn FROM clean c "
                             f"JOIN (SELECT userId, max(flag) AS churn FROM clean GROUP BY userId) u "
                             f"ON c.userId = u.userId")
    q["event_date"] = f"{act}\nSELECT userId, ts, {date_sql('ts')} AS date FROM activity"
    q["state_extract"] = f"{act}\nSELECT userId, ts, location, {state_sql('location')} AS state FROM activity"
    q["last_level_rows"] = (
        f"{cln},\nlasts AS (SELECT userId, max(ts) AS last_ts FROM clean GROUP BY userId)\n"
        f"SELECT c.userId, c.ts, c.page, c.level, c.state, "
        f"CASE WHEN l.userId IS NOT NULL THEN c.level END AS last_level, "
        f"CASE WHEN l.userId IS NOT NULL THEN c.state END AS last_state "
        f"FROM clean c LEFT JOIN lasts l ON c.userId = l.userId AND c.ts = l.last_ts")
    q["drop_null_rows"] = (
        f"{ft}\nSELECT DISTINCT c.userId, c.gender, CAST(u.churn AS INTEGER) AS churn, c.level AS last_level, "
        f"CAST(date_diff('day', u.first_d, u.last_d) AS INTEGER) AS days_active, c.state AS last_state "
        f"FROM clean c JOIN users u ON c.userId = u.userId AND c.ts = u.last_ts "
        f"WHERE c.gender IS NOT NULL AND c.level IS NOT NULL AND c.state IS NOT NULL")
    q["distinct_rows"] = f"{act}\nSELECT DISTINCT userId, level, gender FROM activity"

    # windows as aggregates, single features
    q["user_first_last"] = (
        f"{cln}\nSELECT userId, min(ts) AS first_ts, max(ts) AS last_ts, min(d) AS first_date, "
        f"max(d) AS last_date, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS days_active "
        f"FROM clean GROUP BY userId")
    q["songs_per_day"] = (f"{cln}\nSELECT userId, d AS date, count(*) AS n_songs FROM clean "
                          f"WHERE page = 'NextSong' GROUP BY userId, d")
    q["events_per_day"] = f"{cln}\nSELECT userId, d AS date, count(*) AS n_events FROM clean GROUP BY userId, d"
    q["avg_songs"] = f"{ft}\nSELECT userId, avg_songs FROM songs"
    q["avg_events"] = f"{ft}\nSELECT userId, avg_events FROM evs"
    q["thumbs_up"] = f"{ft}\nSELECT userId, n AS thumbs_up FROM ups"
    q["thumbs_down"] = f"{ft}\nSELECT userId, n AS thumbs_down FROM downs"
    q["add_friend"] = f"{ft}\nSELECT userId, n AS addfriend FROM friends"
    q["days_active"] = (f"{ft}\nSELECT userId, CAST(date_diff('day', first_d, last_d) AS INTEGER) AS days_active "
                        f"FROM users")
    q["last_level"] = f"{ft}\nSELECT userId, level AS last_level FROM lastrow"
    q["last_state"] = f"{ft}\nSELECT userId, state AS last_state FROM lastrow"

    # joins
    base = f"{ft},{BASE}"
    bcols = "b.userId, b.gender, b.churn, b.last_level, b.days_active, b.last_state"
    q["join_songs_inner"] = f"{base}\nSELECT {bcols}, s.avg_songs FROM base b JOIN songs s ON b.userId = s.userId"
    q["join_events_inner"] = f"{base}\nSELECT {bcols}, e.avg_events FROM base b JOIN evs e ON b.userId = e.userId"
    q["join_counts_left"] = (
        f"{base}\nSELECT {bcols}, CAST(coalesce(a.n, 0) AS BIGINT) AS thumbs_up, "
        f"CAST(coalesce(x.n, 0) AS BIGINT) AS thumbs_down, CAST(coalesce(f.n, 0) AS BIGINT) AS addfriend "
        f"FROM base b LEFT JOIN ups a ON b.userId = a.userId LEFT JOIN downs x ON b.userId = x.userId "
        f"LEFT JOIN friends f ON b.userId = f.userId")

    # categories
    top = f"{ft},{TOP}"
    q["state_counts"] = f"{ft}\nSELECT last_state, count(*) AS count FROM features GROUP BY last_state"
    q["top_states"] = (f"{top}\nSELECT last_state, cnt AS count, CAST(rnk AS INTEGER) AS rank FROM ranked "
                       f"WHERE rnk BETWEEN 2 AND 11")
    q["collapse_rare_states"] = (
        f"{top}\nSELECT userId, gender, churn, last_level, days_active, "
        f"CASE WHEN last_state IN (SELECT last_state FROM ranked WHERE rnk BETWEEN 2 AND 11) "
        f"THEN last_state ELSE 'OTHER' END AS last_state, avg_songs, avg_events, thumbs_up, thumbs_down, addfriend "
        f"FROM features")

    # encoding
    for k, v in encoding_sql().items():
        q[k] = v
    return q


def _bucket(expr: str, n: int) -> str:
    return f"CAST(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) % {n} AS INTEGER)"


def _index_ctes(src: str, prefix: str = "") -> str:
    parts = []
    for name, col in (("ig", "gender"), ("il", "last_level"), ("ist", "last_state")):
        parts.append(f"{prefix}{name} AS (SELECT {col} AS val, CAST(row_number() OVER (ORDER BY count(*) DESC, "
                     f"{col} ASC) - 1 AS DOUBLE) AS idx FROM {src} GROUP BY {col})")
    return ",\n".join(parts)


def _entries(enc: str, p: str = "") -> str:
    ng, nl, ns = (f"(SELECT count(*) FROM {p}ig)", f"(SELECT count(*) FROM {p}il)", f"(SELECT count(*) FROM {p}ist)")
    rows = [f"SELECT userId, CAST(gi AS INTEGER) AS i, CAST(1.0 AS DOUBLE) AS v FROM {enc}",
            f"SELECT userId, CAST({ng} + li AS INTEGER) AS i, CAST(1.0 AS DOUBLE) AS v FROM {enc}",
            f"SELECT userId, CAST({ng} + {nl} + si AS INTEGER) AS i, CAST(1.0 AS DOUBLE) AS v FROM {enc}"]
    for j, c in enumerate(NUMERIC[1:]):
        rows.append(f"SELECT userId, CAST({ng} + {nl} + {ns} + {j} AS INTEGER) AS i, CAST({c} AS DOUBLE) AS v "
                    f"FROM {enc} WHERE {c} <> 0")
    return "\nUNION ALL\n".join(rows)


def encoding_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    fold_key = "userId || '#fold'"
    lab = (f"{FEATURE_CTES},\nlab AS (SELECT *, {_bucket('userId', 10)} AS bucket, "
           f"{_bucket(fold_key, 3)} AS fold FROM features),\n"
           f"train AS (SELECT * FROM lab WHERE bucket < 6)")
    q["split_assign"] = (f"{lab}\nSELECT userId, bucket, CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 "
                         f"THEN 'test' ELSE 'valid' END AS split FROM lab")
    q["fold_assign"] = f"{lab}\nSELECT userId, fold FROM lab"
    idx = f"{lab},\n{_index_ctes('train')},\n" + (
        "enc AS (SELECT l.*, ig.idx AS gi, il.idx AS li, ist.idx AS si FROM lab l "
        "JOIN ig ON l.gender = ig.val JOIN il ON l.last_level = il.val JOIN ist ON l.last_state = ist.val)")
    q["string_index"] = f"{idx}\nSELECT userId, gi AS genderIndex, li AS levelIndex, si AS stateIndex FROM enc"
    strict = f"{lab},\n{_index_ctes('lab')}"
    q["string_index_strict"] = (
        f"{strict}\nSELECT l.userId, ig.idx AS genderIndex, il.idx AS levelIndex, ist.idx AS stateIndex FROM lab l "
        f"JOIN ig ON l.gender = ig.val JOIN il ON l.last_level = il.val JOIN ist ON l.last_state = ist.val")
    q["one_hot"] = (f"{idx}\nSELECT userId, 'genderVec' AS vector, CAST(gi AS INTEGER) AS i, "
                    f"CAST(1.0 AS DOUBLE) AS v FROM enc\n"
                    f"UNION ALL SELECT userId, 'levelVec', CAST(li AS INTEGER), CAST(1.0 AS DOUBLE) FROM enc\n"
                    f"UNION ALL SELECT userId, 'stateVec', CAST(si AS INTEGER), CAST(1.0 AS DOUBLE) FROM enc")
    q["assemble_vector"] = f"{idx}\n{_entries('enc')}"
    refined = (f"{lab},\nrk AS (SELECT last_state AS val, row_number() OVER (ORDER BY count(*) DESC, "
               f"last_state ASC) AS rnk FROM train GROUP BY last_state),\n"
               f"lab2 AS (SELECT * REPLACE (CASE WHEN last_state IN (SELECT val FROM rk WHERE rnk BETWEEN 2 AND 11) "
               f"THEN last_state ELSE 'OTHER' END AS last_state) FROM lab),\n"
               f"train2 AS (SELECT * FROM lab2 WHERE bucket < 6),\n{_index_ctes('train2', 'r')},\n"
               "enc2 AS (SELECT l.*, ig.idx AS gi, il.idx AS li, ist.idx AS si FROM lab2 l "
               "JOIN rig ig ON l.gender = ig.val JOIN ril il ON l.last_level = il.val "
               "JOIN rist ist ON l.last_state = ist.val),\n"
               f"e AS ({_entries('enc2', 'r')})")
    q["l1_normalize"] = (f"{refined}\nSELECT userId, i, round(v / sum(abs(v)) OVER (PARTITION BY userId), 9) AS v "
                         f"FROM e")
    # Multinomial naive Bayes (smoothing 1) on the refined, L1-normalised vectors of the train
    # split: log prior ln(n_c + 1) - ln(N + classes), log likelihood ln(tf_cj + 1) - ln(tf_c + F),
    # prediction = class with the greater score (ties -> 0), margin = score_1 - score_0.  Labels are 0/1.
    nfeat = "((SELECT count(*) FROM rig) + (SELECT count(*) FROM ril) + (SELECT count(*) FROM rist) + 6)"
    def bayes(enc: str, entries: str) -> str:
        """CTEs up to raw (userId, r0, r1): log scores of the rows of ``enc``, fitted on the train rows of enc2."""
        return (
            f"x AS (SELECT userId, i, v / sum(abs(v)) OVER (PARTITION BY userId) AS v FROM {entries}),\n"
            f"trx AS (SELECT CAST(m.churn AS DOUBLE) AS label, x.i, x.v FROM x JOIN enc2 m ON x.userId = m.userId "
            f"WHERE m.bucket < 6),\n"
            f"cls AS (SELECT CAST(churn AS DOUBLE) AS label, count(*) AS n FROM enc2 WHERE bucket < 6 GROUP BY 1),\n"
            f"pri AS (SELECT label, ln(n + 1.0) - ln((SELECT sum(n) FROM cls) + (SELECT count(*) FROM cls)) AS p "
            f"FROM cls),\n"
            f"tf AS (SELECT label, i, sum(v) AS s FROM trx GROUP BY label, i),\n"
            f"tot AS (SELECT label, ln(sum(s) + {nfeat}) AS d FROM tf GROUP BY label),\n"
            f"raw AS (SELECT x.userId,\n"
            f"  (SELECT p FROM pri WHERE label = 0.0) + sum(x.v * (ln(coalesce(t0.s, 0) + 1.0) "
            f"- (SELECT d FROM tot WHERE label = 0.0))) AS r0,\n"
            f"  (SELECT p FROM pri WHERE label = 1.0) + sum(x.v * (ln(coalesce(t1.s, 0) + 1.0) "
            f"- (SELECT d FROM tot WHERE label = 1.0))) AS r1\n"
            f"  FROM x LEFT JOIN tf t0 ON t0.label = 0.0 AND t0.i = x.i LEFT JOIN tf t1 ON t1.label = 1.0 AND t1.i = x.i\n"
            f"  GROUP BY x.userId)")

    one, zero = "CAST(1.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)"
    nb = (f"{refined},\n{bayes('enc2', 'e')},\nnb AS (SELECT m.userId, CASE WHEN m.bucket < 6 THEN 'train' "
          f"WHEN m.bucket < 8 THEN 'test' ELSE 'valid' END AS split, CAST(m.churn AS DOUBLE) AS label, "
          f"CASE WHEN r.r1 > r.r0 THEN {one} ELSE {zero} END AS prediction, round(r.r1 - r.r0, 6) AS margin "
          f"FROM enc2 m JOIN raw r ON m.userId = r.userId)")
    q["nb_score"] = f"{nb}\nSELECT userId, split, label, prediction, margin FROM nb"
    q["model_save_load"] = f"{nb}\nSELECT userId, split, label, prediction FROM nb"
    q["nb_f1"] = (
        f"{nb},\ncm AS (SELECT split, label, prediction, count(*) AS n FROM nb GROUP BY 1, 2, 3),\n"
        f"sup AS (SELECT split, label, sum(n) AS support FROM cm GROUP BY 1, 2),\n"
        f"prd AS (SELECT split, prediction AS label, sum(n) AS predicted FROM cm GROUP BY 1, 2),\n"
        f"tp AS (SELECT split, label, n AS tp FROM cm WHERE label = prediction),\n"
        f"m AS (SELECT s.split, s.support, CASE WHEN coalesce(p.predicted, 0) > 0 THEN coalesce(t.tp, 0) / p.predicted "
        f"ELSE 0.0 END AS pr, coalesce(t.tp, 0) / s.support AS rc FROM sup s "
        f"LEFT JOIN tp t ON s.split = t.split AND s.label = t.label "
        f"LEFT JOIN prd p ON s.split = p.split AND s.label = p.label)\n"
        f"SELECT split, round(sum(support * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) "
        f"/ sum(support), 9) AS weighted_f1 FROM m GROUP BY split")
    # Scoring keeps users with a category that training has not seen: no entry for it.
    kept = (f"{refined},\nenc3 AS (SELECT l.*, ig.idx AS gi, il.idx AS li, ist.idx AS si FROM lab2 l "
            f"LEFT JOIN rig ig ON l.gender = ig.val LEFT JOIN ril il ON l.last_level = il.val "
            f"LEFT JOIN rist ist ON l.last_state = ist.val),\n"
            f"e3 AS (SELECT * FROM ({_entries('enc3', 'r')}) t WHERE i IS NOT NULL),\n{bayes('enc3', 'e3')}")
    answer = (f"SELECT userId, round(1 / (1 + exp(r0 - r1)), 9) AS p_churn, CASE WHEN r1 > r0 THEN {one} ELSE {zero} END "
              f"AS prediction, CASE WHEN r1 > r0 THEN 'churn' ELSE 'stay' END AS decision FROM raw")
    q["batch_score_nb"] = f"{kept}\n{answer}"
    q["request_score"] = f"{kept}\n{answer}"
    # Trees walked by joins agree with the model for every user whose categories training has seen.
    split = "CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 THEN 'test' ELSE 'valid' END AS split"
    for name in ("gbt_tree_walk", "rf_tree_walk"):
        q[name] = f"{refined}\nSELECT userId, {split}, CAST(churn AS DOUBLE) AS label, TRUE AS agrees FROM enc2"
    # Logistic regression: the gradient at zero weights (each class has its share as probability).  If no feature's
    # exceeds the L1 bound, zero weights are the optimum and every row gets the more frequent class.
    bound = "CAST(0.24 AS DOUBLE)"
    lr = (f"{refined},\nx AS (SELECT userId, i, v / sum(abs(v)) OVER (PARTITION BY userId) AS v FROM e),\n"
          f"tr AS (SELECT userId, CAST(churn AS INTEGER) AS y FROM enc2 WHERE bucket < 6),\n"
          f"nn AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS share FROM tr),\n"
          f"s AS (SELECT x.i, sum(x.v) AS s1, sum(x.v * x.v) AS s2, sum(CASE WHEN tr.y = 1 THEN x.v ELSE 0 END) AS sy "
          f"FROM x JOIN tr ON x.userId = tr.userId GROUP BY x.i),\n"
          f"g AS (SELECT CAST(f.i AS INTEGER) AS i, CASE WHEN s2 - s1 * s1 / n > 1e-12 THEN (share * s1 - sy) / n "
          f"/ sqrt((s2 - s1 * s1 / n) / (n - 1)) ELSE 0.0 END AS g1 "
          f"FROM nn, (SELECT unnest(range({nfeat})) AS i) f LEFT JOIN s ON s.i = f.i)")
    rows = [f"SELECT CAST({k} AS INTEGER) AS class, i, CAST(0.0 AS DOUBLE) AS coefficient, "
            f"round({'-' if k == 0 else ''}coalesce(g1, 0.0), 6) AS gradient, {bound} AS bound, "
            f"coalesce(abs(g1), 0.0) <= {bound} AS optimal FROM g" for k in (0, 1)]
    q["lr_optimality"] = lr + "\n" + "\nUNION ALL\n".join(rows)
    q["lr_score"] = (f"{lr}\nSELECT userId, {split}, CAST(churn AS DOUBLE) AS label, CASE WHEN (SELECT max(abs(g1)) FROM g) "
                     f"<= {bound} THEN CASE WHEN (SELECT share FROM nn) > 0.5 THEN {one} ELSE {zero} END END AS prediction "
                     f"FROM enc2")
    pred = (f"{FEATURE_CTES},\npred AS (SELECT CAST(churn AS DOUBLE) AS label, CASE WHEN thumbs_down > thumbs_up "
            f"THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS prediction FROM features),\n"
            f"cm AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction)")
    q["confusion_matrix"] = f"{pred}\nSELECT label, prediction, n FROM cm"
    q["weighted_f1"] = (
        f"{pred},\nsup AS (SELECT label, sum(n) AS support FROM cm GROUP BY label),\n"
        f"prd AS (SELECT prediction AS label, sum(n) AS predicted FROM cm GROUP BY prediction),\n"
        f"tp AS (SELECT label, n AS tp FROM cm WHERE label = prediction),\n"
        f"m AS (SELECT s.support AS support, CASE WHEN coalesce(p.predicted, 0) > 0 THEN coalesce(t.tp, 0) / "
        f"p.predicted ELSE 0.0 END AS pr, coalesce(t.tp, 0) / s.support AS rc FROM sup s "
        f"LEFT JOIN tp t ON s.label = t.label LEFT JOIN prd p ON s.label = p.label)\n"
        f"SELECT round(sum(support * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) "
        f"/ sum(support), 9) AS weighted_f1 FROM m")
    return q
