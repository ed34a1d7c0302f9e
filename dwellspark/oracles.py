"""SQL for the activity queries, by the same names."""

from __future__ import annotations

from .functions.categories import RULES
from .options import CATEGORIES
from .plans.activity import APPS, CAP_MS

_MS = [f"{c}_ms" for c in CATEGORIES]


def _case(app: str, rules=RULES) -> str:
    arms = " ".join(f"WHEN regexp_matches({app}, '(?i){p}') THEN '{c}'" for p, c in rules)
    return f"CASE WHEN coalesce({app}, '') = '' THEN 'other' {arms} ELSE 'other' END"


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g')"


_APP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in APPS.items()) + " END"
_W = f"""w AS (
  SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS session_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) // 1000 AS t, {_APP} AS app_name,
    CASE user_id % 3 WHEN 0 THEN -300 WHEN 1 THEN 0 ELSE 540 END AS timezone_offset, event_type FROM events)"""
_HOT = f"""{_W}, h0 AS (SELECT * EXCLUDE (session_id, seq), CASE WHEN n % 3 = 0 THEN 'hot' ELSE session_id END AS session_id FROM w),
h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, n) - 1 AS seq FROM h0)"""
_COUNTERS = ["key_count", "click_count", "mouse_distance", "scroll_delta", "idle_ms"]
_CNT = ", ".join(_COUNTERS)
_D = f"""{_W}, lead_w AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM w),
d AS (SELECT lpad(event_id, 12, '0') AS id, session_id, event_id AS window_event_id, app_name, timezone_offset, t AS start_monotonic_ms,
    least(greatest(nxt - t, 0), {CAP_MS}) AS dwell_time_ms, t + least(greatest(nxt - t, 0), {CAP_MS}) AS timestamp_ms, seq FROM lead_w WHERE nxt IS NOT NULL)"""
_DW = "session_id, window_event_id, app_name, timezone_offset, timestamp_ms, start_monotonic_ms, dwell_time_ms"
_I = """i AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS t,
    CAST(json_extract(props, '$.k') AS BIGINT) AS key_count, CAST(event_type = 'click' AS BIGINT) AS click_count, CAST(floor(value) AS BIGINT) AS mouse_distance,
    event_id % 7 - 3 AS scroll_delta, event_id % 5 * 1000 AS idle_ms FROM events)"""


def _x(size: int = 30_000) -> str:
    return f"""x AS (
  SELECT *, greatest(least(timestamp_ms, window_start + {size}) - greatest(timestamp_ms - dwell_time_ms, window_start), 0) AS overlap_ms FROM (
    SELECT *, unnest(CASE WHEN dwell_time_ms > 0 THEN range((timestamp_ms - dwell_time_ms) // {size} * {size}, timestamp_ms, {size})
      WHEN timestamp_ms % {size} <> 0 THEN [timestamp_ms // {size} * {size}] ELSE [] END) AS window_start FROM d))"""


_SUMS = ", ".join(f"CAST(sum(CASE WHEN {_case('app_name')} = '{c}' THEN overlap_ms ELSE 0 END) AS BIGINT) AS {c}_ms" for c in CATEGORIES)
_TOP = "CASE " + " ".join(f"WHEN {m} = greatest({', '.join(_MS)}) THEN '{m[:-3]}'" for m in _MS) + " END"


def _features(size: int = 30_000) -> str:
    return f"""{_D}, {_I}, {_x(size)},
fb AS (SELECT session_id, window_start, {_SUMS}, count(*) AS context_switch_count, count(DISTINCT window_event_id) AS opened,
    arg_min(timezone_offset, row(timestamp_ms, id)) AS timezone_offset FROM x GROUP BY ALL),
fa AS (SELECT session_id, window_start, app_name, sum(overlap_ms) AS ms, min(CASE WHEN overlap_ms > 0 THEN row(timestamp_ms, id) END) AS first FROM x GROUP BY ALL),
ft AS (SELECT session_id, window_start, arg_min(app_name, row(-ms, first)) AS top_app FROM fa WHERE ms > 0 GROUP BY ALL),
fi AS (SELECT session_id, t // {size} * {size} AS window_start, sum(key_count) AS k, sum(click_count) AS c, sum(abs(scroll_delta)) AS s, sum(mouse_distance) AS m, sum(idle_ms) AS idle FROM i GROUP BY ALL),
f AS (SELECT fb.*, coalesce(top_app, '') AS top_app_name, {_TOP} AS top_category, coalesce(k, 0) / {size / 1000} AS key_rate, coalesce(c, 0) / {size / 1000} AS click_rate,
    coalesce(s, 0) / {size / 1000} AS scroll_rate, coalesce(m, 0) / {size / 1000} AS mouse_speed, least(greatest(coalesce(idle, 0) / {size}.0, 0.0), 1.0) AS idle_ratio,
    {_iso('window_start')} || 'Z' AS window_start_utc, {_iso('window_start + timezone_offset * 60000')} AS window_start_local
  FROM fb LEFT JOIN ft USING (session_id, window_start) LEFT JOIN fi USING (session_id, window_start)),
g AS (SELECT *, CAST(code_ms + docs_ms >= 20000 AND idle_ratio <= 0.35 AND context_switch_count <= 1 AS INT) AS deep_work_candidate_flag FROM f)"""


_DAILY = f"""{_features()}, daily AS (
  SELECT session_id, window_start_local[1:10] AS local_date, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in _MS)}, CAST(sum(context_switch_count) AS BIGINT) AS context_switches,
    count(*) AS windows, CAST(sum(deep_work_candidate_flag) AS BIGINT) AS deep_work_windows, CAST(sum(deep_work_candidate_flag) * 30000 AS BIGINT) AS deep_work_ms,
    arg_min(timezone_offset, window_start_local) AS tz, CAST(sum({' + '.join(_MS)}) AS BIGINT) AS total_tracked_ms
  FROM g WHERE window_start_local[12:] < '23:59:59.999' GROUP BY ALL)"""
_BOUNDS = """bounds AS (SELECT *, epoch_ms(CAST(local_date AS TIMESTAMP)) - tz * 60000 AS low_ms FROM daily),
dd AS (SELECT d.*, b.local_date FROM d JOIN bounds b ON d.session_id = b.session_id AND timestamp_ms >= low_ms AND timestamp_ms < low_ms + 86400000)"""
_TOPN = "SELECT {k}, app_name, CAST(sum(dwell_time_ms) AS BIGINT) AS total_ms, CAST(row_number() OVER (PARTITION BY {k} ORDER BY sum(dwell_time_ms) DESC, app_name) AS INT) AS rank FROM {t} GROUP BY {k}, app_name"
_WEEK = """week AS (SELECT s.session_id, strftime(day, '%Y-%m-%d') AS local_date FROM (SELECT DISTINCT session_id FROM daily) s, range(DATE '2024-01-04', DATE '2024-01-11', INTERVAL 1 DAY) r(day)),
dense AS (SELECT * FROM week LEFT JOIN daily USING (session_id, local_date))"""
_ASOF = """win AS (SELECT session_id, t, event_id FROM w WHERE {where}),
a AS (SELECT i.*, win.event_id AS active_window_id, win.t AS window_start_ms FROM i ASOF LEFT JOIN win ON i.session_id = win.session_id AND i.t > win.t)"""
_COUNTERS = ("key_count", "click_count", "mouse_distance", "scroll_delta", "idle_ms")
_CSUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTERS)
_DIRTY = " OR ".join(f"sum({c}) > 0" for c in _COUNTERS)
_FMT = "CASE WHEN coalesce({x}, 0) <= 0 THEN '0s' WHEN {x} // 3600000 > 0 THEN ({x} // 3600000) || 'h ' || ({x} // 60000 % 60) || 'm' WHEN {x} // 60000 > 0 THEN ({x} // 60000) || 'm ' || ({x} // 1000 % 60) || 's' ELSE ({x} // 1000) || 's' END"
_LABELS = """seen AS (SELECT {key} AS k, session_id, CAST(seq // 6 AS VARCHAR) AS wid, t, CASE WHEN n % 3 = 0 THEN 'on_goal' ELSE 'related' END AS label FROM w),
s1 AS (SELECT *, CASE WHEN lag(label) OVER o IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM seen WINDOW o AS (PARTITION BY k ORDER BY t, label)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t, label) AS run FROM s1),
s3 AS (SELECT *, min(t) OVER (PARTITION BY k, run) AS since FROM s2),
lab AS (SELECT k, min(session_id) AS session_id, min(wid) AS wid, coalesce(arg_max(label, row(t, run)) FILTER (t - since >= 20000000), 'unknown') AS semantic_label FROM s3 GROUP BY k)"""
_V = """goal AS (SELECT label, 'g' || label AS goal_id, arg_min(embedding, vec_id) AS gv FROM embeddings GROUP BY label),
v AS (SELECT vec_id, embedding, goal_id, gv, label AS goal_label, day_utc, sh, (vec_id % 40) * 1000 AS dwell_ms FROM embeddings e0,
  (SELECT goal_id, gv, label AS goal_label FROM goal) g0, (VALUES ('2024-01-01', 0.1::DOUBLE), ('2024-01-02', 0.0::DOUBLE)) t(day_utc, sh)),
c AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + sh) AS a, list_transform(gv, lambda x: CAST(x AS DOUBLE) {gsh}) AS b FROM v),
sc AS (SELECT *, CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0.0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END AS score FROM c)"""


def _v(gsh: str = "") -> str:
    return _V.replace("{gsh}", gsh).replace("label AS goal_label, day_utc", "goal_label, day_utc")


_SCORE = """m AS (SELECT *, dwell_ms >= 2000 AS known, CASE WHEN goal_label % 2 = 0 THEN 0.15 ELSE 0.0 END AS boost FROM sc),
m2 AS (SELECT *, CASE WHEN known THEN score ELSE 0 END AS sim, CASE WHEN known THEN least(greatest(score + boost, 0.0), 1.0) ELSE 0 END AS fin FROM m),
m3 AS (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN fin >= 0.5 THEN 'on_goal' WHEN fin >= 0.3 THEN 'related' ELSE 'off_goal' END AS label,
  CASE WHEN NOT known OR dwell_ms < 10000 THEN 'low' WHEN dwell_ms <= 30000 THEN 'medium' ELSE 'high' END AS confidence FROM m2)"""
_CAL = """kc AS (SELECT goal_id, day_utc, score, row_number() OVER (PARTITION BY goal_id ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY goal_id) AS n FROM sc WHERE day_utc = '2024-01-01'),
cal AS (SELECT goal_id, day_utc, greatest(max(score) FILTER (r = least(floor(0.8::DOUBLE * n), n - 1)), 0.45::DOUBLE) AS t_on, max(score) FILTER (r = least(floor(0.5::DOUBLE * n), n - 1)) AS t_off, max(n) AS sample_count
  FROM kc WHERE n >= 5 GROUP BY goal_id, day_utc HAVING avg(score) >= -1),
th AS (SELECT * FROM cal UNION ALL SELECT goal_id, day_utc, 0.2::DOUBLE, 0.1::DOUBLE, 0 FROM goal, (VALUES ('2024-01-01'), ('2024-01-02')) o(day_utc)
  WHERE label % 2 = 0 AND NOT EXISTS (SELECT 1 FROM cal WHERE cal.goal_id = goal.goal_id AND cal.day_utc = o.day_utc))"""
_LOG = f"""{_W}, j AS (SELECT 'events-' || session_id AS file, seq AS pos, session_id, n, CASE WHEN n % 101 = 0 THEN greatest(seq - 1, 0) ELSE seq END AS s FROM w),
l AS (SELECT *, n % 97 <> 0 AS ok FROM j)"""
_TAIL = f"""{_LOG}, tl AS (SELECT file, coalesce(arg_max(s, pos) FILTER (ok), -1) AS tail_seq, coalesce(max(pos) FILTER (ok), -1) AS lastok FROM l GROUP BY file),
tail AS (SELECT l.file, tail_seq, count(*) FILTER (NOT ok AND pos > lastok) AS truncated_lines FROM l JOIN tl USING (file) GROUP BY l.file, tail_seq),
ck AS (SELECT file AS session_id, tail_seq, tail_seq + CAST(substring(file, 8) AS BIGINT) % 3 - 1 AS last_flushed_seq FROM tail)"""
_HOST = "regexp_extract(url, '//([^/]+)', 1)"
_SAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?i)https?://([^/\\s?#\"<>]+)[^\\s\"<>]*', '\\1', 'g'),"
    " '[a-zA-Z0-9._%+\\-]+@([a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}})', '***@\\1', 'g'),"
    " '[A-Za-z]:\\\\(?:[^\\\\<>:\"/|?*\\r\\n\\s]+\\\\)*([^\\\\<>:\"/|?*\\r\\n\\s]+)([^\\\\<>:\"/|?*\\r\\n\\s]|$)', '\\1\\2', 'g'),"
    " '/(?:[^\\s/\\\\:*?\"<>|]+/)+([^\\s/\\\\:*?\"<>|]+)([^\\s/\\\\:*?\"<>|]|$)', '\\1\\2', 'g')[1:512]"
)
_PAGE_TITLE = "'Visit ' || url || ' mail user' || page_id || '@site.org C:\\Users\\bob\\doc' || page_id || '.txt in /var/log/app/' || page_id || '.log of /tmp'"

SQL = {
    "assign_seq": f"WITH {_W} SELECT session_id, event_id, seq, t AS timestamp, app_name, timezone_offset FROM w",
    "window_changes": f"""WITH {_W}, p AS (SELECT session_id, event_id, seq, app_name FROM w WHERE n % 13 <> 0 )
      SELECT session_id, event_id, app_name FROM (SELECT *, lag(app_name) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM p) WHERE b IS DISTINCT FROM app_name""",
    "dwell_from_windows": f"WITH {_D} SELECT {_DW} FROM d",
    "heartbeat_split": f"""WITH {_D}, p AS (SELECT *, unnest(range(start_monotonic_ms, greatest(start_monotonic_ms + dwell_time_ms, start_monotonic_ms + 1), 30000)) AS begun FROM d)
      SELECT session_id, window_event_id, app_name, timezone_offset, least(begun + 30000, timestamp_ms) AS timestamp_ms, begun AS start_monotonic_ms, least(begun + 30000, timestamp_ms) - begun AS dwell_time_ms FROM p""",
    "dwell_time_range": f"WITH {_D} SELECT min(timestamp_ms - dwell_time_ms) AS min_ts, max(timestamp_ms) AS max_ts FROM d WHERE dwell_time_ms > 0",
    "dwells_in_range": f"WITH {_D} SELECT {_DW} FROM d WHERE timestamp_ms - dwell_time_ms < 1705000000000 AND timestamp_ms > 1704500000000",
    "session_dwells": f"WITH {_D} SELECT {_DW} FROM d WHERE session_id = '1'",
    "confirm_labels": f"WITH {_W}, {_LABELS.format(key="session_id || '-' || (seq // 6)")} SELECT session_id, wid AS window_event_id, semantic_label FROM lab",
    "categorize_apps": f"WITH {_W} SELECT event_id, {_case('app_name')} AS category FROM w",
    "categorize_join": f"SELECT page_id, {_case(_HOST, [('chrome', 'video'), *RULES])} AS category FROM pages",
    "sanitize_title": f"SELECT page_id, {_SAN.format(t=_PAGE_TITLE)} AS clean FROM pages",
    "resolve_poll": f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Chrome' ELSE {_SAN.format(t='url')} END AS app_name, {_SAN.format(t='url')} AS window_title,
      CASE WHEN page_id % 3 = 0 THEN '  Chrome ' WHEN page_id % 3 = 1 THEN '  ' END AS process_name FROM pages""",
    "normalize_title": f"""WITH p AS (SELECT page_id, lower('(' || page_id || ') Watch Later - ' || {_HOST} || ' [HD] 12:30 ' || page_id || ' views follow-up 0123456789abcdef012 - YouTube - Google Chrome') AS raw FROM pages),
      a AS (SELECT *, regexp_replace(regexp_replace(raw, '^[(\\[]\\d+[)\\]]\\s*', ''), '[(\\[]\\s*(4k|8k|hd|uhd|live|new)\\s*[)\\]]', ' ', 'g') AS t FROM p),
      b AS (SELECT *, regexp_replace(regexp_replace(t, '\\b\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?\\b', ' ', 'g'), '\\b\\d+([.,]\\d+)?\\s*[kmb]?\\s*(views?|watching|watchers?)\\b', ' ', 'g') AS u FROM a),
      c AS (SELECT *, trim(regexp_replace(regexp_replace(u, '\\b([0-9a-f]{{16,}}|\\d{{10,}})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM b),
      d AS (SELECT *, trim(regexp_replace(trim(regexp_replace(v, '(\\s*-\\s*(google chrome|youtube)\\s*)+$', '')), '^watch later\\s*-\\s*', '')) AS h FROM c)
      SELECT page_id, trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(h, '\\s*-\\s*'), lambda y: y <> '' AND trim(y) NOT IN ('chrome', 'edge', 'firefox', 'safari', 'brave', 'opera')), ' '), '\\s+', ' ', 'g'))[1:180] AS normalized,
        nullif(regexp_extract(raw, '\\b([a-z0-9-]+\\.(com|org|net|io|dev|ai|app|co|edu|gov))\\b', 1), '') AS hint FROM d""",
    "app_boost": f"""WITH {_W} SELECT event_id, CASE WHEN n % 2 = 0 AND contains(lower(app_name), 'tube') THEN 0.15 WHEN n % 2 <> 0 AND n % 3 = 0 AND contains('my slack app', lower(app_name)) THEN 0.15 ELSE 0.0 END::DOUBLE AS boost FROM w""",
    "goal_text": """SELECT p_partkey, lower(regexp_replace(trim('  Read ' || p_name || '  '), '\\s+', ' ', 'g')) AS goal,
      '  Read ' || p_name || '  ' || CASE WHEN p_partkey % 2 = 0 THEN ' [app: ' || p_brand || ']' ELSE '' END AS shown FROM part""",
    "inputs_asof_window": f"WITH {_W}, {_I}, {_ASOF.format(where='n % 4 = 0')} SELECT session_id, t AS monotonic_ms, active_window_id, window_start_ms, key_count FROM a",
    "input_summaries": f"""WITH {_W}, {_I}, {_ASOF.format(where='n % 4 = 0')} SELECT session_id, active_window_id, t // 3600000 * 3600000 AS slot_ms, {_CSUM}, max(t - window_start_ms) AS dwell_time_ms
      FROM a WHERE active_window_id IS NOT NULL GROUP BY ALL HAVING {_DIRTY}""",
    "accumulate_inputs": f"WITH {_I} SELECT session_id, {_CSUM} FROM i GROUP BY session_id HAVING {_DIRTY}",
    "inputs_in_range": f"WITH {_I} SELECT id, session_id, t AS timestamp_ms, key_count FROM i WHERE t >= 1704500000000 AND t < 1705000000000",
    "dwell_x_bucket": f"WITH {_D}, {_x()} SELECT session_id, window_event_id, window_start, overlap_ms FROM x",
    "app_ms": f"WITH {_D}, {_x()} SELECT session_id, window_start, app_name, CAST(sum(overlap_ms) AS BIGINT) AS ms, count(*) AS n_rows FROM x GROUP BY ALL",
    "bucket_inputs": f"""WITH {_I} SELECT session_id, t // 30000 * 30000 AS window_start, CAST(sum(key_count) AS BIGINT) AS keys_n, CAST(sum(click_count) AS BIGINT) AS clicks_n, CAST(sum(mouse_distance) AS BIGINT) AS mouse_n,
      CAST(sum(idle_ms) AS BIGINT) AS idle_n, CAST(sum(abs(scroll_delta)) AS BIGINT) AS scroll_n FROM i GROUP BY ALL""",
    "build_features": f"""WITH {_features()} SELECT session_id, window_start, window_start_utc, window_start_local, timezone_offset, {', '.join(_MS)}, context_switch_count, top_app_name, top_category,
      deep_work_candidate_flag, {', '.join(f'round({c}, 6) AS {c}' for c in ('key_rate', 'click_rate', 'scroll_rate', 'mouse_speed', 'idle_ratio'))} FROM g""",
    "top_key": f"WITH {_features()} SELECT session_id, window_start, top_app_name, top_category FROM g",
    "features_60s": f"""WITH {_features(60_000)}, z AS (SELECT *, CAST(window_start_local AS TIMESTAMP) AS lt FROM g) SELECT session_id, window_start, opened AS context_switch_count, code_ms,
      CAST(video_ms * 2 > 60000 AS INT) AS video_like_flag, CAST(hour(lt) >= 22 OR hour(lt) < 6 AS INT) AS night_flag, CAST(isodow(lt) < 6 AS INT) AS weekday_flag FROM z""",
    "features_on_local_day": f"WITH {_features()} SELECT session_id, window_start_local, other_ms, code_ms FROM g WHERE window_start_local >= '2024-01-05T00:00:00' AND window_start_local < '2024-01-05T23:59:59.999'",
    "upsert_features": f"WITH {_features()} SELECT session_id, window_start, CASE WHEN window_start % 7 = 0 THEN -1 ELSE code_ms END AS code_ms FROM g",
    "daily_totals": f"WITH {_DAILY} SELECT * EXCLUDE (tz) FROM daily",
    "top_apps": f"WITH {_D} SELECT session_id, app_name, total_ms, rank FROM ({_TOPN.format(k='session_id', t='d')}) WHERE rank <= 2",
    "top_distractions": f"WITH {_D}, dx AS (SELECT * FROM d WHERE {_case('app_name')} IN ('video', 'social', 'game')) SELECT session_id, app_name, total_ms, rank FROM ({_TOPN.format(k='session_id', t='dx')}) WHERE rank <= 3",
    "day_bounds_join": f"WITH {_DAILY}, {_BOUNDS} SELECT session_id, local_date, count(*) AS dwells, CAST(sum(dwell_time_ms) AS BIGINT) AS total_ms FROM dd GROUP BY ALL",
    "daily_report": f"""WITH {_DAILY}, {_BOUNDS}, tops AS ({_TOPN.format(k='session_id, local_date', t='dd')})
      SELECT session_id, local_date, deep_work_ms, rank, app_name, total_ms FROM daily JOIN tops USING (session_id, local_date) WHERE rank <= 3""",
    "weekly_report": f"""WITH {_DAILY}, {_WEEK} SELECT session_id, min(local_date) AS first_day, max(local_date) AS last_day, {', '.join(f'CAST(sum(coalesce({m}, 0)) AS BIGINT) AS {m}' for m in _MS)},
      CAST(sum(coalesce(deep_work_ms, 0)) AS BIGINT) AS deep_work_ms, CAST(sum(coalesce(context_switches, 0)) AS BIGINT) AS context_switches, CAST(count(*) AS INT) AS days FROM dense GROUP BY session_id""",
    "dense_days": f"WITH {_DAILY}, {_WEEK} SELECT session_id, local_date, coalesce(code_ms, 0) AS code_ms, coalesce(windows, 0) AS windows FROM dense",
    "deep_work_blocks": f"""WITH {_features()}, r AS (SELECT session_id, window_start, window_start - row_number() OVER (PARTITION BY session_id ORDER BY window_start) * 30000 AS run FROM g WHERE deep_work_candidate_flag = 1)
      SELECT session_id, min(window_start) AS block_start, max(window_start) + 30000 AS block_end, count(*) AS windows FROM r GROUP BY session_id, run""",
    "report_text": f"""WITH {_DAILY}, {_BOUNDS}, tops AS ({_TOPN.format(k='session_id, local_date', t='dd')}),
      ta AS (SELECT session_id, local_date, string_agg('  ' || rpad(app_name[1:32], 33, ' ') || ' ' || {_FMT.format(x='total_ms')}, chr(10) ORDER BY rank) AS apps FROM tops WHERE rank <= 3 GROUP BY ALL)
      SELECT session_id, local_date, concat_ws(chr(10), '', '╔══════════════════════════════════╗', '║   Daily Report — ' || local_date || '    ║', '╚══════════════════════════════════╝', '', 'Category Breakdown:',
      {', '.join(f"CASE WHEN {m} > 0 THEN '  ' || rpad('{m[:-3]}', 7, ' ') || ' ' || rpad(repeat('█', CAST(floor({m} / total_tracked_ms * 20 + 0.5) AS INT)), 20, '░') || ' ' || lpad({_FMT.format(x=m)}, 8, ' ') END" for m in _MS)},
      '', '  Total tracked:   ' || {_FMT.format(x='total_tracked_ms')}, '  Deep work:       ' || {_FMT.format(x='deep_work_ms')}, '  Context switches: ' || context_switches,
      chr(10) || 'Top Apps:' || chr(10) || apps, '') AS report FROM daily LEFT JOIN ta USING (session_id, local_date)""",
    "report_text_weekly": f"""WITH {_DAILY}, {_WEEK}, z AS (SELECT session_id, local_date, {', '.join(f'coalesce({m}, 0) AS {m}' for m in [*_MS, 'deep_work_ms', 'context_switches'])} FROM dense),
      y AS (SELECT session_id, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in [*_MS, 'deep_work_ms', 'context_switches'])}, min(local_date) AS d0, max(local_date) AS d1,
        string_agg('  ' || local_date || '  ' || rpad({_FMT.format(x='deep_work_ms')}, 9, ' ') || '  ' || rpad({_FMT.format(x='code_ms')}, 9, ' ') || '  ' || lpad(CAST(context_switches AS VARCHAR), 4, ' '), chr(10) ORDER BY local_date) AS days FROM z GROUP BY session_id)
      SELECT session_id, concat_ws(chr(10), '', '╔══════════════════════════════════════════════╗', '║  Weekly Report — ' || d0 || ' to ' || d1 || '  ║', '╚══════════════════════════════════════════════╝', '',
        '  Total deep work:      ' || {_FMT.format(x='deep_work_ms')}, '  Total ctx switches:   ' || context_switches, '',
        '  code:   ' || {_FMT.format(x='code_ms')} || '   docs: ' || {_FMT.format(x='docs_ms')} || '   video: ' || {_FMT.format(x='video_ms')},
        '  social: ' || {_FMT.format(x='social_ms')} || '   game: ' || {_FMT.format(x='game_ms')} || '   other: ' || {_FMT.format(x='other_ms')}, '',
        'Daily Trend:', '  Date        Deep Work  Code       Ctx±', '  ──────────  ─────────  ─────────  ────', days, '') AS report FROM y""",
    "weekly_trend": f"WITH {_DAILY}, {_WEEK} SELECT session_id, local_date, {', '.join(f'coalesce({m}, 0) AS {m}' for m in [*_MS, 'deep_work_ms', 'context_switches'])}, coalesce(windows, 0) AS window_count FROM dense",
    "report_json": f"""WITH {_DAILY} SELECT '{{"session_id":"' || session_id || '","local_date":"' || local_date || '","code_ms":' || code_ms || '}}' AS json FROM daily""",
    "fmt_duration": f"WITH {_D} SELECT window_event_id, {_FMT.format(x='(dwell_time_ms * 40)')} AS text FROM d",
    "time_functions": f"""WITH {_W} SELECT event_id, {_iso('t')} || 'Z' AS utc, {_iso('t + timezone_offset * 60000')} AS local, t // 30000 * 30000 AS bucket,
      strftime(make_timestamp((t + timezone_offset * 60000) * 1000), '%Y%m%d') AS day_key, (t + timezone_offset * 60000) // 86400000 * 86400000 - timezone_offset * 60000 AS day_start_ms FROM w""",
    "score_windows": f"WITH {_v()}, {_SCORE} SELECT vec_id, goal_id AS goal, day_utc, round(sim, 6) AS sim_score, round(fin, 6) AS final_score, label, confidence FROM m3",
    "calibrate_thresholds": f"""WITH {_v('+ sh')}, k AS (SELECT goal_id, day_utc, score, row_number() OVER (PARTITION BY goal_id, day_utc ORDER BY score) - 1 AS r, count(*) OVER p AS n, avg(score) OVER p AS mean FROM sc WINDOW p AS (PARTITION BY goal_id, day_utc))
      SELECT goal_id, day_utc, round(greatest(max(score) FILTER (r = least(floor(0.8::DOUBLE * n), n - 1)), 0.45), 6) AS t_on, round(max(score) FILTER (r = least(floor(0.5::DOUBLE * n), n - 1)), 6) AS t_off, max(n) AS sample_count
      FROM k WHERE n >= 100 AND mean >= 0.3 GROUP BY goal_id, day_utc""",
    "upsert_calibration": f"WITH {_v()}, {_CAL} SELECT goal_id, day_utc, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, sample_count FROM th",
    "score_calibrated": f"""WITH {_v()}, {_SCORE}, {_CAL}, u AS (SELECT m3.*, t_on IS NOT NULL AS has, coalesce(t_on, 0.5) AS t_on, coalesce(t_off, 0.3) AS t_off FROM m3 LEFT JOIN th USING (goal_id, day_utc))
      SELECT vec_id, goal_id AS goal, day_utc, CASE WHEN has THEN 'calibrated' ELSE 'fixed' END AS threshold_mode, CASE WHEN known THEN round(t_on, 6) END AS t_on, CASE WHEN known THEN round(t_off, 6) END AS t_off,
        CASE WHEN NOT known THEN 'unknown' WHEN fin >= t_on THEN 'on_goal' WHEN fin >= t_off THEN 'related' ELSE 'off_goal' END AS label FROM u""",
    "compare_models": f"""WITH {_v()}, {_SCORE}, s05 AS (SELECT * REPLACE (list_transform(a, lambda x: x + 0.05) AS a) FROM c), q AS (SELECT vec_id, goal_id, day_utc, dwell_ms, least(greatest(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 0.0), 1.0) AS f FROM s05),
      y AS (SELECT vec_id, CASE WHEN dwell_ms < 2000 THEN 0 ELSE f END AS f, CASE WHEN dwell_ms < 2000 THEN 'unknown' WHEN f >= 0.5 THEN 'on_goal' WHEN f >= 0.3 THEN 'related' ELSE 'off_goal' END AS lb FROM q WHERE goal_id = 'g1' AND day_utc = '2024-01-01')
      SELECT vec_id, round(f - fin, 6) AS delta, lb = label AS label_same FROM m3 JOIN y USING (vec_id) WHERE goal_id = 'g1' AND day_utc = '2024-01-01'""",
    "on_goal_time": f"WITH {_v()}, {_SCORE} SELECT goal_id, day_utc, label, CAST(sum(dwell_ms) AS BIGINT) AS total_ms FROM m3 WHERE label <> 'unknown' GROUP BY ALL",
    "goal_table": f"""WITH {_W}, lg AS (SELECT session_id AS user_id, seq AS at_ms, CASE WHEN n % 5 = 0 THEN 'clear' ELSE 'set' END AS action, 'Do ' || event_id AS todo_text, CASE WHEN n % 2 = 0 THEN app_name END AS app_hint FROM w),
      e AS (SELECT *, max(at_ms) OVER (PARTITION BY user_id) AS last, max(CASE WHEN action = 'clear' THEN at_ms END) OVER (PARTITION BY user_id) AS cleared FROM lg),
      cr AS (SELECT user_id, min(at_ms) AS created_at_ms FROM e WHERE action = 'set' AND at_ms > coalesce(cleared, -1) GROUP BY user_id)
      SELECT user_id, todo_text || CASE WHEN app_hint IS NULL THEN '' ELSE ' [app: ' || app_hint || ']' END AS text, todo_text, app_hint, lower(todo_text) AS normalized_text, created_at_ms, at_ms AS updated_at_ms
      FROM e JOIN cr USING (user_id) WHERE at_ms = last AND action = 'set'""",
    "embed_distinct": "SELECT p_partkey, CAST(length(trim(p_brand)) AS DOUBLE) AS v0 FROM part",
    "audit_log": f"WITH {_LOG} SELECT file, count(*) AS lines, count(*) FILTER (NOT ok) AS parse_errors, 0::BIGINT AS missing_seq, CAST(min(pos) FILTER (NOT ok) AS INT) AS first_bad_pos FROM l GROUP BY file",
    "log_tail_seq": f"WITH {_TAIL} SELECT file, tail_seq, CAST(truncated_lines AS INT) AS truncated_lines, truncated_lines > 0 AS truncated FROM tail",
    "audit_sequence": f"""WITH {_LOG}, q AS (SELECT session_id, s, row_number() OVER (PARTITION BY session_id ORDER BY s) - 1 AS r FROM l)
      SELECT session_id, count(*) AS records, count(DISTINCT s) AS distinct_seqs, min(s) AS first_seq, max(s) AS last_seq, min(r) FILTER (r <> s) AS expected_seq, arg_min(s, r) FILTER (r <> s) AS found_seq FROM q GROUP BY session_id""",
    "reconcile_checkpoint": f"""WITH {_TAIL} SELECT session_id, tail_seq, last_flushed_seq, CASE WHEN tail_seq = last_flushed_seq THEN 'A' WHEN tail_seq > last_flushed_seq THEN 'B' ELSE 'C' END AS "case",
      tail_seq <> last_flushed_seq AS checkpoint_updated, tail_seq AS resume_seq FROM ck""",
    "audit_checkpoint": f"WITH {_TAIL} SELECT session_id, tail_seq, last_flushed_seq FROM ck WHERE last_flushed_seq > tail_seq",
    "validate_events": f"""WITH {_W} SELECT event_id AS id, CASE WHEN n % 19 = 0 THEN 'record' WHEN n % 11 = 0 THEN 'event_id' WHEN n % 13 = 0 THEN 'seq' WHEN n % 17 = 0 THEN 'created_at' END AS violation FROM w""",
    "insert_or_ignore": f"""WITH {_W}, e AS (SELECT n, CASE WHEN n % 23 = 0 THEN 'dup' ELSE event_id END AS event_id, session_id, seq FROM w), o AS (SELECT * FROM e WHERE n % 10 = 0 AND event_id <> 'dup'),
      a AS (SELECT * FROM e WHERE n % 29 <> 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n) = 1), b AS (SELECT * FROM a WHERE event_id NOT IN (SELECT event_id FROM o)),
      c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY n) = 1)
      SELECT event_id, session_id, seq FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = c.session_id AND o.seq = c.seq)""",
    "events_raw": f"""WITH {_W} SELECT event_id AS id, session_id, seq, 'x' AS created_at, timezone_offset, t AS timestamp_ms, CAST(t AS DOUBLE) AS monotonic_ms, event_type AS type,
      '{{"event_id":"' || event_id || '","session_id":"' || session_id || '","seq":' || seq || ',"created_at":"x","timezone_offset":' || timezone_offset || ',"timestamp":' || t || ',"monotonic_ms":' || t || ',"type":"' || event_type || '"}}' AS payload_json FROM w""",
    "merge_streams": f"""WITH {_I} SELECT session_id, 'active_window' AS type, count(*) AS n, NULL::BIGINT AS keys_n FROM i GROUP BY session_id UNION ALL
      SELECT session_id, 'input_summary', count(*), CAST(sum(key_count) AS BIGINT) FROM i GROUP BY session_id""",
    "log_file_order": """WITH o AS (SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS log_date, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 12 AS INT) END AS r FROM orders)
      SELECT 'events-' || log_date || CASE WHEN r IS NULL THEN '' ELSE '.' || r END || '.jsonl' AS file, log_date, coalesce(r, 0) AS rotation,
        CAST(row_number() OVER (ORDER BY log_date DESC, coalesce(r, 0) DESC, r IS NULL) AS INT) AS newest FROM o""",
    "retention_purge": """WITH f AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS file, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS log_day_ms, count(*) AS bytes FROM orders GROUP BY ALL)
      SELECT *, log_day_ms < 900000000000 - 2000 * 86400000::BIGINT OR sum(bytes) OVER (ORDER BY log_day_ms DESC, file DESC) > 500 AS purge FROM f""",
    "stream_dwell": f"""WITH {_W}, z AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM w)
      SELECT session_id, event_id AS window_event_id, app_name, t AS start_monotonic_ms, greatest(nxt, t) AS end_monotonic_ms, greatest(nxt - t, 0) AS dwell_time_ms FROM z WHERE nxt IS NOT NULL""",
    "stream_window_changes": f"WITH {_W} SELECT session_id, seq, app_name FROM (SELECT *, lag(app_name) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM w) WHERE b IS DISTINCT FROM app_name",
    "stream_dedup": f"WITH {_W} SELECT event_id FROM w",
    "stream_confirm_label": f"WITH {_W}, {_LABELS.format(key="session_id || '-' || (seq // 6)")} SELECT k AS window_event_id, semantic_label FROM lab WHERE semantic_label <> 'unknown'",
    "stream_input_summary": f"""WITH {_W}, {_I}, {_ASOF.format(where='true')}, y AS (SELECT *, max(t) OVER () AS top FROM a WHERE active_window_id IS NOT NULL)
      SELECT session_id, active_window_id, t // 3600000 * 3600000 AS slot_ms, {_CSUM} FROM y WHERE t // 3600000 * 3600000 + 3600000 <= top GROUP BY ALL HAVING {_DIRTY}""",
    "hot_dwells": f"WITH {_HOT}, z AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM h) SELECT session_id, event_id AS window_event_id, app_name, timezone_offset, nxt AS timestamp_ms, t AS start_monotonic_ms, nxt - t AS dwell_time_ms, seq FROM z WHERE nxt IS NOT NULL",
    "hot_changes": f"WITH {_HOT} SELECT session_id, event_id, app_name FROM h QUALIFY lag(app_name) OVER (PARTITION BY session_id ORDER BY seq) IS DISTINCT FROM app_name",
    "hot_asof": f"""WITH {_HOT}, {_I}, x AS (SELECT CASE WHEN n % 2 = 0 THEN 'hot' ELSE session_id END AS session_id, t, 0 AS k, key_count, scroll_delta, NULL AS id, NULL::BIGINT AS opened FROM i UNION ALL SELECT session_id, t, 1, NULL, NULL, event_id, t FROM h),
      a AS (SELECT *, last_value(id IGNORE NULLS) OVER o AS active_window_id, last_value(opened IGNORE NULLS) OVER o AS window_start_ms FROM x WINDOW o AS (PARTITION BY session_id ORDER BY t, k, id ROWS UNBOUNDED PRECEDING))
      SELECT session_id, t AS monotonic_ms, key_count, scroll_delta, active_window_id, window_start_ms FROM a WHERE k = 0""",
    "hot_audit": f"""WITH {_HOT}, q AS (SELECT session_id, CASE WHEN n % 101 = 0 THEN seq + 1 ELSE seq END AS s FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s) - 1 AS r FROM q)
      SELECT session_id, count(*) AS records, count(DISTINCT s) AS distinct_seqs, min(s) AS first_seq, max(s) AS last_seq, min(r) FILTER (r <> s) AS expected_seq, arg_min(s, r) FILTER (r <> s) AS found_seq FROM r GROUP BY session_id""",
    "hot_labels": f"""WITH {_HOT}, l AS (SELECT session_id, t, CASE WHEN n % 3 <> 0 THEN 'related' WHEN seq // 5 % 2 = 0 THEN 'on_goal' ELSE 'off' END AS label FROM h),
      a AS (SELECT *, CAST(lag(label) OVER (PARTITION BY session_id ORDER BY t, label) IS DISTINCT FROM label AS INT) AS new FROM l), b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t, label ROWS UNBOUNDED PRECEDING) AS run FROM a),
      c AS (SELECT *, min(t) OVER (PARTITION BY session_id, run) AS since FROM b)
      SELECT session_id, 'w' AS window_event_id, coalesce(arg_max(label, (t, run)) FILTER (t - since >= 20000000), 'unknown') AS semantic_label FROM c GROUP BY session_id""",
    "input_summaries_carried": f"""WITH RECURSIVE {_W}, {_I}, j AS (SELECT n, id, session_id, t, scroll_delta, CASE WHEN n % 5 = 0 THEN key_count ELSE 0 END AS key_count, CASE WHEN n % 5 = 0 THEN click_count ELSE 0 END AS click_count,
        CASE WHEN n % 5 = 0 THEN mouse_distance ELSE 0 END AS mouse_distance, CASE WHEN n % 5 = 0 THEN idle_ms ELSE 0 END AS idle_ms FROM i),
      x AS (SELECT session_id, t, 0 AS k, {_CNT}, NULL::VARCHAR AS id, NULL::BIGINT AS opened FROM j UNION ALL SELECT session_id, t, 1, 0, 0, 0, 0, 0, event_id, t FROM w WHERE n % 4 = 0),
      a AS (SELECT *, last_value(id IGNORE NULLS) OVER o AS win, last_value(opened IGNORE NULLS) OVER o AS since FROM x WINDOW o AS (PARTITION BY session_id ORDER BY t, k, id ROWS UNBOUNDED PRECEDING)),
      cells AS (SELECT session_id, win, t // 3600000 * 3600000 AS slot, min(since) AS since, max(t - since) AS dwell, {", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in _COUNTERS)} FROM a WHERE k = 0 GROUP BY ALL),
      nth AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY win IS NOT NULL, slot, since, win) AS r FROM cells),
      f AS (SELECT session_id, win, slot, dwell, r, key_count AS k, click_count AS c, mouse_distance AS m, scroll_delta AS s, idle_ms AS i, win IS NOT NULL AND (key_count > 0 OR click_count > 0 OR mouse_distance > 0 OR scroll_delta > 0 OR idle_ms > 0) AS out FROM nth WHERE r = 1
        UNION ALL SELECT n.session_id, n.win, n.slot, n.dwell, n.r, n.key_count + CASE WHEN out THEN 0 ELSE k END, n.click_count + CASE WHEN out THEN 0 ELSE c END, n.mouse_distance + CASE WHEN out THEN 0 ELSE m END, n.scroll_delta + CASE WHEN out THEN 0 ELSE s END,
          n.idle_ms + CASE WHEN out THEN 0 ELSE i END, n.win IS NOT NULL AND (n.key_count + CASE WHEN out THEN 0 ELSE k END > 0 OR n.click_count + CASE WHEN out THEN 0 ELSE c END > 0 OR n.mouse_distance + CASE WHEN out THEN 0 ELSE m END > 0
            OR n.scroll_delta + CASE WHEN out THEN 0 ELSE s END > 0 OR n.idle_ms + CASE WHEN out THEN 0 ELSE i END > 0) FROM f JOIN nth AS n ON n.session_id = f.session_id AND n.r = f.r + 1)
      SELECT session_id, win AS active_window_id, slot AS slot_ms, k AS key_count, c AS click_count, m AS mouse_distance, s AS scroll_delta, i AS idle_ms, dwell AS dwell_time_ms FROM f WHERE out""",
    "stream_heartbeats": f"""WITH {_W}, z AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY seq), t + 36000000), t + 36000000) AS nxt FROM w),
      p AS (SELECT *, unnest(generate_series(t, greatest(t, nxt - 1), 7200000)) AS s FROM z)
      SELECT session_id, event_id AS window_event_id, app_name, s AS start_monotonic_ms, least(s + 7200000, nxt) AS end_monotonic_ms, least(s + 7200000, nxt) - s AS dwell_time_ms FROM p""",
    "stream_fanout": f"""WITH {_D}, {_I}, e AS (SELECT 'active_window' AS kind, n, 'w' || n AS id, session_id, seq * 2 AS seq, t FROM w UNION ALL
        SELECT 'window_dwell', CAST(window_event_id AS BIGINT), 'd' || window_event_id, session_id, seq * 2 + 1, timestamp_ms FROM d UNION ALL SELECT 'input_summary', n, 'i' || n, session_id, n + 1000000000, t FROM i),
      v AS (SELECT * FROM e WHERE n % 29 <> 0), x AS (SELECT * FROM v UNION ALL SELECT * REPLACE ('x' || id AS id) FROM v WHERE t < 1705276800000 AND n % 15 = 0)
      SELECT 'events_raw' AS sink, id, session_id, seq, t AS timestamp_ms FROM v UNION ALL SELECT kind, id, session_id, seq, t FROM x WHERE kind <> 'active_window'""",
    "read_generations": f"""WITH {_W} SELECT event_id, session_id, seq, CASE WHEN n % 3 = 1 THEN 'window_dwell' WHEN n % 3 = 2 AND n % 2 = 0 THEN 'input_summary' ELSE 'active_window' END AS type, t AS timestamp,
      CASE WHEN n % 3 <> 0 OR (n % 21 <> 0 AND n % 33 <> 0 AND n % 15 <> 0) THEN app_name END AS app_name,
      CASE WHEN n % 2 = 0 AND (n % 3 = 2 OR n % 3 = 0 AND n % 21 <> 0 AND n % 33 <> 0 AND n % 15 <> 0) THEN n END AS key_count FROM w""",
    "validate_types": f"""WITH {_W} SELECT event_id AS id, CASE WHEN n % 31 = 0 THEN 'schema_version' WHEN n % 37 = 0 THEN 'record' WHEN n % 17 = 0 THEN 'schema_version' WHEN n % 19 = 0 OR n % 23 = 0 THEN 'seq'
      WHEN n % 29 = 0 THEN 'monotonic_ms' WHEN n % 7 = 0 OR n % 11 = 0 OR n % 13 = 0 THEN 'payload' END AS violation FROM w""",
    "read_event_log": f"""WITH {_W} SELECT CASE WHEN n % 19 <> 0 THEN session_id END AS session_id, 'active_window' AS type, count(*) AS n, max(CASE WHEN n % 19 <> 0 THEN seq END) AS last_seq,
      count(*) FILTER (n % 19 = 0) AS corrupt FROM w GROUP BY 1""",
    "route_events": f"""WITH {_D} SELECT session_id, event_id, 'active_window' AS type, t AS timestamp_ms, CAST(t AS DOUBLE) AS monotonic_ms FROM w
      UNION ALL SELECT session_id, id, 'window_dwell', timestamp_ms, CAST(timestamp_ms AS DOUBLE) FROM d""",
    "event_ids": f"""WITH {_W}, h AS (SELECT *, 'myhost' || session_id || '-' || t AS hd, md5(session_id || '|' || seq) AS m FROM w)
      SELECT event_id, hd || '-' || sha256(hd)[1:8] AS made_session, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS made_event FROM h""",
}

SQL |= {
    "window_records": f"""WITH {_W}, p AS (SELECT *, CASE WHEN n % 7 <> 0 THEN app_name END AS a, CASE WHEN n % 21 <> 0 THEN CASE WHEN n % 3 = 0 THEN event_type ELSE 'page' END END AS ti FROM w),
      q AS (SELECT *, coalesce(a, ti) AS app, coalesce(ti, '') AS title FROM p WHERE a IS NOT NULL OR ti IS NOT NULL),
      c AS (SELECT * FROM q QUALIFY lag(app || '|' || title) OVER (PARTITION BY session_id ORDER BY t, n) IS DISTINCT FROM app || '|' || title), z AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY session_id ORDER BY t, n) - 1 AS seq FROM c),
      h AS (SELECT *, md5(session_id || '|' || seq) AS m FROM z)
      SELECT '1.1.0' AS schema_version, 'active_window' AS type, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS event_id, session_id, seq, {_iso('t')} || 'Z' AS created_at, timezone_offset, t AS timestamp,
        t AS monotonic_ms, app AS app_name, title AS window_title, 'WINDOW_CHANGE' AS trigger_reason, CASE WHEN n % 5 = 0 THEN 'com.x' END AS bundle_id, CASE WHEN n % 2 = 0 THEN 'p.exe' ELSE a END AS process_name FROM h""",
    "log_folder": f"""WITH {_W}, l AS (SELECT n, n % 2 = 0 AS rot, strftime(make_timestamp(t * 1000), '%Y%m%d') AS log_date, '{{"session_id":"' || session_id || '","seq":' || n || '}}' AS text FROM w),
      k AS (SELECT *, CASE WHEN n % 97 = 0 THEN text[1:20] ELSE text END AS line, n % 97 = 0 AS bad, row_number() OVER (PARTITION BY log_date, rot ORDER BY n) - 1 AS pos FROM l),
      g AS (SELECT log_date, rot, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, count(*) AS lines, count(*) FILTER (bad) AS parse_errors, CAST(min(pos) FILTER (bad) AS INT) AS first_bad_pos, coalesce(max(n) FILTER (NOT bad), -1) AS tail_seq,
          coalesce(max(pos) FILTER (NOT bad), -1) AS good, max(pos) AS last FROM k GROUP BY ALL)
      SELECT 'events-' || log_date || CASE WHEN rot THEN '.1' ELSE '' END || '.jsonl' AS file, log_date, CAST(rot AS INT) AS rotation, CAST(row_number() OVER (ORDER BY log_date DESC, rot DESC) AS INT) AS newest, bytes, lines, parse_errors, first_bad_pos, tail_seq,
        CAST(last - good AS INT) AS truncated_lines FROM g""",
    "boosts": """WITH x AS (SELECT page_id, ['google chrome', 'visual studio code', 'cmd', 'youtube', 'netflix app', 'mail'][page_id % 6 + 1] AS a, lower(url || ' ' || ['LeetCode 12', 'a Pull Request', 'shorts', 'MySQL and Netflix', 'nothing'][page_id % 5 + 1]) AS t FROM pages)
      SELECT page_id, CASE WHEN contains(a, 'visual studio code') THEN 0.15 WHEN a = 'cmd' THEN 0.12 WHEN contains(a, 'chrome') AND contains(t, 'leetcode') THEN 0.2 WHEN a = 'youtube' THEN -0.3 WHEN contains(a, 'netflix') THEN -0.4 ELSE 0 END::DOUBLE AS app_boost,
        CASE WHEN regexp_matches(t, 'leetcode|pull request|jira|design doc|sql') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(t, 'youtube|shorts|netflix|tiktok|instagram') THEN -0.15 ELSE 0 END::DOUBLE AS keyword_boost FROM x""",
    "boosts_by_table": """WITH k AS (SELECT CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name ELSE split_part(p_name, ' ', -1) END AS term, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS app, (p_partkey % 41 - 20) / 100 AS boost FROM part),
      kd AS (SELECT term, app, max(boost) AS boost, min(boost) AS low FROM k GROUP BY ALL), m AS (SELECT p_partkey, app IS NOT NULL AS own, unnest([boost, low]) AS b FROM part JOIN kd ON contains(' the ' || p_name || ' ', ' ' || term || ' ') AND (app IS NULL OR app = p_brand))
      SELECT p_partkey, round(coalesce(arg_max(b, (own, abs(b), b)), 0), 2)::DOUBLE AS boost FROM part LEFT JOIN m USING (p_partkey) GROUP BY p_partkey""",
    "categorize_many": """WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id WHEN 1 THEN 'app q' || page_id || 'z' WHEN 2 THEN 'b z' || page_id || ' x 99' END AS a FROM pages),
      r AS (SELECT p_partkey * 2 AS no, 'q' || p_partkey || 'z' AS p1, 'z' || p_partkey || ' x' AS p2, 'plain' || p_partkey % 5 AS c FROM part),
      h AS (SELECT page_id, no, c FROM x JOIN r ON contains(a, p1) OR contains(a, p2) UNION ALL SELECT page_id, 101, 'seven' FROM x WHERE regexp_matches(a, '^a[0-9]+7$') UNION ALL SELECT page_id, 1000001, 'late' FROM x WHERE regexp_matches(a, 'b.*99'))
      SELECT page_id, coalesce(arg_min(c, no), 'other') AS category FROM x LEFT JOIN h USING (page_id) GROUP BY page_id""",
    "weekly_days": f"""WITH {_DAILY}, {_BOUNDS}, {_WEEK}, tops AS ({_TOPN.format(k='session_id, local_date', t='dd')})
      SELECT session_id, local_date, coalesce(windows, 0) AS windows, coalesce(deep_work_ms, 0) AS deep_work_ms, rank, app_name FROM dense LEFT JOIN (SELECT * FROM tops WHERE rank <= 2) AS t USING (session_id, local_date)""",
    "compare_models_all": f"""WITH {_v()}, {_SCORE}, s05 AS (SELECT * REPLACE (list_transform(a, lambda x: x + 0.05) AS a) FROM c),
      q AS (SELECT vec_id, goal_id, day_utc, dwell_ms, least(greatest(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) + CASE WHEN goal_label % 2 = 0 THEN 0.15 ELSE 0.0 END, 0.0), 1.0) AS f FROM s05),
      y AS (SELECT vec_id, goal_id, day_utc, CASE WHEN dwell_ms < 2000 THEN 0 ELSE f END AS f, CASE WHEN dwell_ms < 2000 THEN 'unknown' WHEN f >= 0.5 THEN 'on_goal' WHEN f >= 0.3 THEN 'related' ELSE 'off_goal' END AS lb FROM q)
      SELECT vec_id, goal_id AS goal, day_utc, round(f - fin, 6) AS delta, lb = label AS label_same FROM m3 JOIN y USING (vec_id, goal_id, day_utc)""",
    "score_forced": f"WITH {_v()}, {_SCORE} SELECT vec_id, goal_id AS goal, day_utc, 'fixed' AS threshold_mode, label FROM m3",
    "features_calm": f"WITH {_features()} SELECT session_id, window_start, CAST(code_ms + docs_ms >= 5000 AND context_switch_count <= 3 AND video_ms + social_ms + game_ms <= 2000 AS INT) AS deep_work_candidate_flag FROM g",
    "write_features": f"WITH {_features()} SELECT kind, session_id, window_start, code_ms, window_start_local[1:10] AS local_date FROM g, (VALUES ('parquet'), ('csv')) AS k(kind)",
    "inputs_in_days": f"WITH {_I} SELECT id, session_id, t AS timestamp_ms FROM i WHERE t >= 1704412800000 AND t < 1704758400000",
    "dwells_uncut": f"""WITH {_W}, z AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM w), p AS (SELECT *, unnest(generate_series(t, greatest(t, nxt - 1), 3600000)) AS s FROM z WHERE nxt IS NOT NULL)
      SELECT session_id, event_id AS window_event_id, s AS start_monotonic_ms, least(s + 3600000, nxt) - s AS dwell_time_ms FROM p""",
    "log_round_trip": f"WITH {_W} SELECT event_id, session_id, seq, t AS epoch_ms, app_name FROM w",
}

# streams end at what their batch twins give
SQL["stream_asof_summaries"] = SQL["input_summaries_carried"]
SQL["stream_features"] = SQL["build_features"]
