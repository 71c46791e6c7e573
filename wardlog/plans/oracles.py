"""DuckDB SQL for the registered queries, over the test tables themselves."""

import re

from wardlog import fixed_values as fixed


def ts(column):
    """Time as text, with microseconds only if there are any."""
    plain = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return (
        f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN {plain} "
        f"ELSE strftime({column}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


def sec(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def among(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FX = """
ev AS (
  SELECT event_id, ts, user_id, event_type AS kind, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
fx AS (
  SELECT event_id, kind, k, user_id,
    'job' || (user_id % 3) AS job_id, event_id + 1 AS line_number, ts AS event_time,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS source_ip,
    '192.0.2.1' AS destination_ip,
    CASE (user_id + k) % 10 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'Admin' WHEN 3 THEN 'administrator'
      WHEN 9 THEN NULL ELSE 'user' || user_id END AS username,
    CASE WHEN kind = 'error' AND k % 4 = 0 THEN 'unauthorized' WHEN kind = 'error' AND k % 4 = 1 THEN 'invalid_user'
      WHEN kind = 'error' THEN 'login_failed' WHEN kind = 'signup' AND k % 3 = 0 THEN 'session_opened'
      WHEN kind = 'signup' THEN 'login_success' WHEN kind = 'view' AND k % 4 = 0 THEN 'forbidden'
      WHEN kind = 'view' AND k % 4 = 1 THEN 'server_error' WHEN kind = 'view' THEN 'access'
      WHEN kind = 'click' AND k % 2 = 1 THEN 'firewall_block' WHEN kind = 'click' THEN 'firewall_allow'
      WHEN k % 3 = 0 THEN 'waf_block' WHEN k % 3 = 1 THEN 'waf_allow' ELSE 'waf_count' END AS event_type,
    CASE k % 25 WHEN 0 THEN '/page?file=../../etc/passwd' WHEN 1 THEN '/search?q=<script>alert(1)</script>'
      WHEN 2 THEN '/q?id=1 union select 1' WHEN 3 THEN '/.env' WHEN 4 THEN '/run?c=;cat' WHEN 5 THEN NULL
      ELSE '/api/' || kind || '/' || (k % 7) END AS endpoint,
    CASE WHEN k % 2 = 1 THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN kind = 'error' THEN CASE k % 3 WHEN 0 THEN 401 WHEN 1 THEN 404 ELSE 503 END
      WHEN kind = 'view' AND k % 4 = 0 THEN 403 ELSE 200 END AS status_code,
    CAST(floor(value * 102400) AS BIGINT) AS response_size,
    'ua/' || (k % 5) AS user_agent,
    CASE WHEN kind = 'purchase' THEN CASE WHEN k % 20 = 0 THEN '' ELSE 'rule-' || (k % 20) END END AS rule
  FROM ev),
fxm AS (SELECT *, concat_ws(' ', method, endpoint) AS message FROM fx)
"""


def over(sql, *ctes):
    return "WITH " + ",\n".join([FX.strip(), *[c.strip() for c in ctes]]) + "\n" + sql


ENTRY = f"job_id, line_number, {sec('event_time')} AS event_time, {sec('event_time')} AS event_time_local"
ORACLES = {}

# --- normalisers ---------------------------------------------------------------
ORACLES["normalize_auth_lines"] = over(f"""
SELECT {ENTRY},
  CASE kind WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_success' WHEN 'view' THEN 'session_opened'
    WHEN 'click' THEN 'sudo_command' ELSE 'connection_closed' END AS event_type,
  'user' || user_id AS username,
  CASE WHEN kind IN ('view', 'click') THEN NULL ELSE source_ip END AS source_ip,
  CASE kind WHEN 'error' THEN 'Failed password for user' || user_id || ' from ' || source_ip || ' port ' || k || ' ssh2'
    WHEN 'signup' THEN 'Accepted password for user' || user_id || ' from ' || source_ip || ' port ' || k || ' ssh2'
    WHEN 'view' THEN 'pam_unix(sshd:session): session opened for user user' || user_id
    WHEN 'click' THEN 'user' || user_id || ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/run ' || k
    ELSE 'Connection closed by authenticating user user' || user_id || ' ' || source_ip || ' port ' || k END AS message,
  'host' AS hostname, CASE WHEN kind = 'click' THEN 'sudo' ELSE 'sshd' END AS service,
  CASE WHEN kind = 'click' THEN '/bin/run ' || k END AS command
FROM fx""")

HOURS = "TIMESTAMP '2023-06-01 00:00:00' + to_hours(event_id)"
ORACLES["normalize_auth_over_years"] = over(f"""
SELECT 'e' || event_id AS hostname, {sec(HOURS)} AS event_time, 'login_failed' AS event_type,
  CAST(dayofyear({HOURS}) AS INTEGER) AS day FROM fx""")

CLASSIFY = """CASE WHEN {s} = 401 THEN 'unauthorized' WHEN {s} = 403 THEN 'forbidden' WHEN {s} = 404 THEN 'not_found'
    WHEN {s} >= 500 THEN 'server_error' WHEN {s} >= 400 THEN 'client_error'
    WHEN regexp_matches(lower({p}), '/login|/auth|/signin') THEN 'authentication'
    WHEN regexp_matches(lower({p}), '/admin|/dashboard|/manage') THEN 'admin_access'
    WHEN {m} IN ('POST', 'PUT', 'DELETE', 'PATCH') THEN 'modification' ELSE 'access' END"""
PATH = "pa AS (SELECT *, coalesce(replace(endpoint, ' ', '+'), '/') AS path FROM fx)"
_class = CLASSIFY.format(s="status_code", p="path", m="method")
ORACLES["normalize_access_lines"] = over(f"""
SELECT {ENTRY}, {_class} AS event_type, username, source_ip, path AS endpoint, method, status_code, response_size,
  user_agent, method || ' ' || path || ' -> ' || status_code AS message, '-' AS referrer, 'HTTP/1.1' AS protocol
FROM pa""", PATH)

LEVEL = "CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'crit' END"
ORACLES["normalize_nginx_error_lines"] = over(f"""
SELECT {ENTRY}, 'error_' || {LEVEL} AS event_type, source_ip, 'msg ' || k || ', client: ' || source_ip AS message,
  {LEVEL} AS level, CAST(k AS VARCHAR) AS pid
FROM fx WHERE line_number % 5 <> 0""")

ORACLES["normalize_json_lines"] = over(f"""
SELECT {ENTRY}, {LEVEL} AS event_type, 'user' || user_id AS username, source_ip, path AS endpoint, status_code,
  'msg ' || k AS message, CAST(k AS VARCHAR) AS k
FROM pa""", PATH)

ORACLES["json_times_of_many_forms"] = over(f"""
SELECT line_number, CASE WHEN event_id % 18 < 14 THEN {sec('event_time')} ELSE {sec("date_trunc('day', event_time)")} END AS event_time
FROM fx""")

ACTION = "CASE WHEN k % 2 = 0 THEN 'BLOCK' ELSE 'ALLOW' END"
VERDICT = "CASE WHEN k % 2 = 0 THEN 'firewall_block' ELSE 'firewall_allow' END"
ORACLES["normalize_firewall_iptables"] = over(f"""
SELECT {ENTRY}, {VERDICT} AS event_type, source_ip, destination_ip,
  'UFW ' || {ACTION} || ' TCP ' || source_ip || ':' || k || ' -> 192.0.2.1:22' AS message,
  'UFW ' || {ACTION} AS action, 'TCP' AS protocol, CAST(k AS VARCHAR) AS source_port, '22' AS destination_port,
  'eth0' AS interface_in, CAST(NULL AS VARCHAR) AS interface_out, 'fw' AS hostname
FROM fx""")
PF_ACTION = "CASE WHEN k % 2 = 0 THEN 'block' ELSE 'pass' END"
ORACLES["normalize_firewall_pf"] = over(f"""
SELECT {ENTRY}, {VERDICT} AS event_type, source_ip, destination_ip,
  {PF_ACTION} || ' in ' || source_ip || ':' || k || ' -> 192.0.2.1:22' AS message, {PF_ACTION} AS action,
  'in' AS direction, 'em0' AS interface, CAST(k AS VARCHAR) AS source_port, '22' AS destination_port
FROM fx""")
ORACLES["normalize_firewall_kv"] = over(f"""
SELECT job_id, line_number, CAST(NULL AS VARCHAR) AS event_time, CAST(NULL AS VARCHAR) AS event_time_local,
  {VERDICT} AS event_type, source_ip, destination_ip,
  'ACTION=' || {ACTION} || ' SRC=' || source_ip || ' DST=192.0.2.1 K=' || k AS message,
  {ACTION} AS "ACTION", source_ip AS "SRC", '192.0.2.1' AS "DST", CAST(k AS VARCHAR) AS "K"
FROM fx""")

WAF = """
wf AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'COUNT' ELSE 'CAPTCHA' END AS action,
    CASE k % 4 WHEN 0 THEN 'waf_block' WHEN 1 THEN 'waf_allow' WHEN 2 THEN 'waf_count' ELSE 'waf_event' END AS waf_type,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'rule-' || (k % 20) END AS waf_rule
  FROM fx),
wm AS (
  SELECT *, method || ' ' || coalesce(endpoint, '') || ' action=' || action
    || CASE WHEN waf_rule <> '' THEN ' rule=' || waf_rule ELSE '' END AS waf_message
  FROM wf)"""
ORACLES["normalize_waf_rows"] = over(f"""
SELECT {ENTRY}, waf_type AS event_type, source_ip, endpoint, method, waf_message AS message, 'h' || (k % 3) AS host,
  'DE' AS country, action, waf_rule AS terminating_rule
FROM wm""", WAF)
ORACLES["read_waf_files"] = over(f"""
SELECT line_number AS row, {sec('event_time')} AS event_time, waf_type AS event_type, source_ip, uri AS endpoint,
  method || ' ' || coalesce(uri, '') || ' action=' || action
    || CASE WHEN waf_rule <> '' THEN ' rule=' || waf_rule ELSE '' END AS message
FROM (SELECT *, CASE WHEN line_number % 10 = 0 THEN '/a' || chr(10) || chr(10) || 'b,' || line_number ELSE endpoint END AS uri
  FROM wf)""", WAF)

_class2 = CLASSIFY.format(s="status_code", p="path", m="method")
ORACLES["classify_requests"] = over(f"""
SELECT {_class2} AS event_type, status_code AS status, method, count(*) AS requests
FROM (SELECT *, CASE k % 6 WHEN 0 THEN '/Login' WHEN 1 THEN '/x/ADMIN/y' ELSE coalesce(endpoint, '/') END AS path FROM fx)
GROUP BY 1, 2, 3""")

LINES = f"""
ln AS (
  SELECT *,
    CASE kind
      WHEN 'error' THEN hd || ' host sshd[' || k || ']: Failed password for user' || user_id || ' from ' || source_ip || ' port ' || k || ' ssh2'
      WHEN 'signup' THEN hd || ' host sshd[' || k || ']: Accepted password for user' || user_id || ' from ' || source_ip || ' port ' || k || ' ssh2'
      WHEN 'view' THEN hd || ' host sshd[' || k || ']: pam_unix(sshd:session): session opened for user user' || user_id
      WHEN 'click' THEN hd || ' host sudo: user' || user_id || ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/run ' || k
      ELSE hd || ' host sshd[' || k || ']: Connection closed by authenticating user user' || user_id || ' ' || source_ip || ' port ' || k
    END AS auth,
    source_ip || ' - ' || coalesce(username, '-') || ' [' || strftime(event_time, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
      || method || ' ' || path || ' HTTP/1.1" ' || status_code || ' ' || response_size || ' "-" "' || user_agent || '"' AS access,
    strftime(event_time, '%Y/%m/%d %H:%M:%S') || ' [' || {LEVEL} || '] ' || k || '#0: *1 msg ' || k || ', client: ' || source_ip AS error,
    '{{"path":"' || path || '","level":"' || {LEVEL} || '"}}' AS json,
    hd || ' fw kernel: [1.0] [UFW ' || {ACTION} || '] IN=eth0 OUT= SRC=' || source_ip || ' DST=192.0.2.1 PROTO=TCP SPT=' || k || ' DPT=22' AS kernel,
    hd || ' fw pf: rule ' || k || '/0(match): ' || CASE WHEN k % 2 = 0 THEN 'block' ELSE 'pass' END || ' in on em0: '
      || source_ip || '.' || k || ' > 192.0.2.1.22' AS pf,
    'ACTION=' || {ACTION} || ' SRC=' || source_ip || ' DST=192.0.2.1 K=' || k AS pairs
  FROM (SELECT *, strftime(event_time, '%b %-d %H:%M:%S') AS hd FROM pa)),
mixed AS (
  SELECT form, event_id // 200 AS file, event_id % 200 + 1 AS line_number, kind, k, source_ip, endpoint, path, status_code, method,
    (event_id // 200) % 4 = 3 AND k % 5 < 2 AS junk, raw
  FROM (SELECT *, unnest(['auth', 'access', 'error', 'json', 'kernel', 'pf', 'pairs']) AS form,
    unnest([auth, access, error, json, kernel, pf, pairs]) AS raw FROM ln))"""
FW_WORDS = "|".join(fixed.FIREWALL_KEYWORDS)
AUTH_WORDS = "|".join(fixed.AUTH_KEYWORDS)
SCORES = f"""
shares AS (
  SELECT form, file,
    avg(CAST(form IN ('auth', 'kernel', 'pf') AND NOT junk AND regexp_matches(raw, ': ') AS INTEGER)) AS auth_share,
    max(CAST(NOT junk AND regexp_matches(raw, '{AUTH_WORDS}') AS INTEGER)) AS auth_named,
    avg(CAST(form = 'access' AND NOT junk AS INTEGER)) AS access,
    avg(CAST(form = 'error' AND NOT junk AS INTEGER)) AS error,
    avg(CAST(form = 'json' AND NOT junk AS INTEGER)) AS json,
    least(0.95::DOUBLE, avg(CAST(NOT junk AND regexp_matches(raw, '{FW_WORDS}') AS INTEGER))) AS fw
  FROM mixed WHERE line_number <= 100 GROUP BY form, file),
scores AS (
  SELECT form, file, access, error, json, fw,
    CASE WHEN auth_named = 1 AND auth_share > 0.3 THEN least(0.95::DOUBLE, auth_share + 0.2) ELSE auth_share * 0.7 END AS auth
  FROM shares)"""
BEST = """
best AS (SELECT *, greatest(auth, access, error, json, fw) AS best FROM scores),
chosen AS (
  SELECT *, CASE WHEN best = 0 THEN 'JSON' WHEN auth = best THEN 'Auth' WHEN access = best THEN 'NginxAccess'
    WHEN error = best THEN 'NginxError' WHEN json = best THEN 'JSON' ELSE 'Firewall' END AS format
  FROM best)"""
WAF_FILES = "SELECT DISTINCT 'waf-' || event_id // 200 || '.log' AS source_file"
ORACLES["hinted_file_formats"] = over(f"""
{WAF_FILES}, CASE event_id // 200 % 3 WHEN 0 THEN 'NginxAccess' ELSE '{fixed.WAF}' END AS format,
  CASE event_id // 200 % 3 WHEN 0 THEN 0.0 ELSE 0.98 END::DOUBLE AS score FROM fx UNION ALL
SELECT form || '-' || file || '.log' AS source_file, CASE file % 3 WHEN 0 THEN 'NginxAccess' ELSE format END AS format,
  round_even(CASE file % 3 WHEN 0 THEN access ELSE best END, 6) AS score
FROM chosen""", PATH, LINES, SCORES, BEST)
ORACLES["detect_file_formats"] = over(f"""
{WAF_FILES}, '{fixed.WAF}' AS format, 0.98::DOUBLE AS score FROM fx UNION ALL
SELECT form || '-' || file || '.log' AS source_file,
  format, round_even(best, 6) AS score
FROM chosen""", PATH, LINES, SCORES, BEST)
ORACLES["normalize_mixed_files"] = over(f"""
SELECT form || '-' || file AS job_id,
  CASE form
    WHEN 'auth' THEN CASE WHEN junk THEN 'unknown' ELSE CASE kind WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_success'
      WHEN 'view' THEN 'session_opened' WHEN 'click' THEN 'sudo_command' ELSE 'connection_closed' END END
    WHEN 'access' THEN CASE WHEN junk THEN 'unparsed' ELSE {_class} END
    WHEN 'error' THEN 'error_' || {LEVEL}
    WHEN 'json' THEN CASE WHEN junk THEN 'unparsed' ELSE {LEVEL} END
    ELSE CASE WHEN junk THEN 'firewall_unparsed' ELSE {VERDICT} END END AS event_type,
  count(*) AS entries,
  count(CASE WHEN NOT junk AND (form <> 'auth' OR kind NOT IN ('view', 'click')) THEN 1 END) AS with_ip
FROM mixed WHERE form <> 'error' OR NOT junk GROUP BY 1, 2
UNION ALL SELECT 'waf-' || file, CASE WHEN junk THEN 'waf_event' ELSE CASE k % 4 WHEN 0 THEN 'waf_block' WHEN 1 THEN 'waf_allow'
  WHEN 2 THEN 'waf_count' ELSE 'waf_event' END END, count(*), count(*) FILTER (NOT junk) FROM mixed WHERE form = 'auth' GROUP BY 1, 2""", PATH, LINES)
ORACLES["parse_statistics"] = over("""
SELECT job_id, count(*) AS total_lines, count(CASE WHEN line_number % 5 <> 0 THEN 1 END) AS parsed_lines
FROM fx GROUP BY job_id""")
ORACLES["read_text_files"] = over("""
SELECT event_id, event_id || ' ' || access AS raw_line, CAST(1 AS BIGINT) AS first_line FROM ln""", PATH, LINES)
ORACLES["listed_files"] = "SELECT 'txt' AS extension, count(*) > 0 AS has_data FROM events UNION ALL SELECT 'csv', count(*) > 0 FROM events"
ORACLES["stored_entries"] = over(f"""
SELECT {ENTRY}, event_type, source_ip, endpoint, response_size, CAST(2000 AS INTEGER) AS raw_length, rule FROM fxm""")
ORACLES["stored_whole_lines"] = over(f"""
SELECT {ENTRY}, event_type, CAST(length(raw) AS INTEGER) AS raw_length, sha256(raw) AS raw_sha256
FROM (SELECT *, message || repeat('x', 2000) AS raw FROM fxm)""")

# --- detectors --------------------------------------------------------------------
FAILED, LOGINS = among(fixed.FAILED_LOGIN_TYPES), among(fixed.SUCCESS_LOGIN_TYPES)
PRIVILEGED = among(fixed.PRIVILEGED_ACCOUNTS)
BURSTS = f"""
fails AS (
  SELECT job_id, source_ip, event_time AS ts, line_number, username,
    count(*) OVER (PARTITION BY job_id, source_ip ORDER BY event_time
      RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS inside,
    count(*) OVER (PARTITION BY job_id, source_ip, event_time) AS n,
    row_number() OVER (PARTITION BY job_id, source_ip, event_time ORDER BY line_number) AS place
  FROM fx WHERE event_type IN {FAILED}),
bursts AS (
  SELECT job_id, source_ip, ts AS last_ts, greatest(4, inside - n + 1) AS failures,
    greatest(4, inside - n + 1) - (inside - n) AS at_last
  FROM fails WHERE inside >= 4
  QUALIFY row_number() OVER (PARTITION BY job_id, source_ip ORDER BY greatest(4, inside - n + 1) DESC, ts, place) = 1),
burst_rows AS (
  SELECT b.*, f.ts, f.line_number, f.username,
    row_number() OVER (PARTITION BY b.job_id, b.source_ip ORDER BY f.ts, f.line_number) AS rank
  FROM bursts b JOIN fails f ON f.job_id = b.job_id AND f.source_ip = b.source_ip
    AND f.ts >= b.last_ts - INTERVAL 2 DAYS AND (f.ts < b.last_ts OR (f.ts = b.last_ts AND f.place <= b.at_last))),
logins AS (SELECT job_id, source_ip, max(event_time) AS login_ts FROM fx WHERE event_type IN {LOGINS} GROUP BY 1, 2),
brute AS (
  SELECT r.job_id, r.source_ip, any_value(r.failures) AS failed_attempts, min(r.ts) AS first_ts, any_value(r.last_ts) AS last_ts,
    string_agg(DISTINCT r.username, ', ' ORDER BY r.username) AS target_account,
    string_agg(CASE WHEN r.rank <= 10 THEN CAST(r.line_number AS VARCHAR) END, ',' ORDER BY r.rank) AS sample_lines,
    coalesce(any_value(l.login_ts) > any_value(r.last_ts), false) AS success
  FROM burst_rows r LEFT JOIN logins l ON l.job_id = r.job_id AND l.source_ip = r.source_ip GROUP BY 1, 2),
brute_alerts AS (
  SELECT *, CASE WHEN success OR failed_attempts >= 50 THEN 'critical' WHEN failed_attempts >= 30 THEN 'high'
    WHEN failed_attempts >= 20 THEN 'medium' ELSE 'low' END AS severity FROM brute)"""
ORACLES["brute_force"] = over(f"""
SELECT job_id, source_ip, severity, target_account, failed_attempts,
  (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6 AS duration_seconds, {ts('first_ts')} AS first_attempt,
  {ts('last_ts')} AS last_attempt, CAST(success AS VARCHAR) AS success_after_failures, sample_lines
FROM brute_alerts""", BURSTS)
ORACLES["burst_targets"] = over("""
SELECT job_id, source_ip, unnest(string_split(target_account, ', ')) AS username FROM brute_alerts
WHERE target_account IS NOT NULL""", BURSTS)
ORACLES["success_after_burst"] = over(f"""
SELECT job_id, source_ip, failed_attempts AS count, {ts('last_ts')} AS last_attempt FROM brute WHERE success""", BURSTS)

OFF_HOURS = f"""
off_hours AS (
  SELECT * FROM fx WHERE event_type IN {LOGINS} AND lower(username) IN {PRIVILEGED}
    AND (hour(event_time) < 6 OR hour(event_time) >= 22))"""
ORACLES["off_hours_login"] = over(f"""
SELECT job_id, source_ip, username AS target_account, 'high' AS severity,
  'User ''' || username || ''' logged in at ' || strftime(event_time, '%H:%M:%S')
    || ' (outside 6:00-22:00 working hours) from IP ' || source_ip || '. This may indicate unauthorized access.' AS description,
  CAST(hour(event_time) AS INTEGER) AS hour, line_number, {ts('event_time')} AS login_time
FROM off_hours""", OFF_HOURS)
MULTI = f"""
multi AS (
  SELECT job_id, source_ip, string_agg(DISTINCT username, ', ' ORDER BY username) AS names,
    count(DISTINCT username) AS accounts, count(*) AS login_count
  FROM fx WHERE event_type IN {among(fixed.PRIVILEGED_USE_TYPES)} AND lower(username) IN {PRIVILEGED}
  GROUP BY 1, 2 HAVING count(DISTINCT username) > 1)"""
ORACLES["multi_privileged"] = over("""
SELECT job_id, source_ip, 'critical' AS severity, names AS target_account,
  'IP ' || source_ip || ' accessed ' || accounts || ' privileged accounts: ' || names
    || '. This may indicate credential stuffing or lateral movement.' AS description, login_count
FROM multi""", MULTI)
STREAKS = f"""
tries AS (
  SELECT job_id, username, event_time, line_number, source_ip, event_type IN {LOGINS} AS ok,
    coalesce(sum(CAST(event_type IN {LOGINS} AS INTEGER)) OVER (PARTITION BY job_id, username
      ORDER BY event_time, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM fx WHERE username IS NOT NULL AND event_type IN {among(fixed.STREAK_FAILURE_TYPES + fixed.SUCCESS_LOGIN_TYPES)}),
counted AS (
  SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY job_id, username, run) AS streak FROM tries),
streaks AS (SELECT * FROM counted WHERE ok AND streak >= 5)"""
ORACLES["login_after_failures"] = over(f"""
SELECT job_id, source_ip, username AS target_account,
  'Successful Login After ' || streak || ' Failures for ''' || username || '''' AS title,
  CAST(streak AS BIGINT) AS failure_count, {ts('event_time')} AS success_time, line_number
FROM streaks""", STREAKS)


def signature_sql(target):
    """VALUES-like list of matched categories over a text column."""
    tests = []
    for category, patterns in fixed.ATTACK_SIGNATURES.items():
        parts = []
        for pattern, any_case in patterns:
            quoted = pattern.replace("'", "''")
            parts.append(f"regexp_matches({target}, '{quoted}', '{'i' if any_case else 'c'}')")
        tests.append(f"CASE WHEN {' OR '.join(parts)} THEN '{category}' END")
    return "[" + ", ".join(tests) + "]"


HITS = f"""
hits AS (
  SELECT * FROM (SELECT *, unnest({signature_sql('coalesce(endpoint, message)')}) AS category FROM fxm)
  WHERE category IS NOT NULL),
ranked_hits AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, category, source_ip ORDER BY line_number) AS place FROM hits),
web AS (
  SELECT job_id, category, source_ip, count(*) AS n,
    string_agg(CASE WHEN place <= 10 THEN CAST(line_number AS VARCHAR) END, ',' ORDER BY line_number) AS sample_lines,
    string_agg(DISTINCT CASE WHEN place <= 5 THEN endpoint END, '|' ORDER BY CASE WHEN place <= 5 THEN endpoint END) AS sample_endpoints
  FROM ranked_hits GROUP BY 1, 2, 3),
web_alerts AS (
  SELECT *, category || ' Attempt from ' || source_ip AS title,
    CASE WHEN category = '{fixed.SCANNING}' THEN CASE WHEN n > 10 THEN 'medium' ELSE 'low' END
      WHEN n >= 20 THEN 'critical' WHEN n >= 10 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS severity
  FROM web)"""
ORACLES["attack_categories"] = over("SELECT job_id, line_number, category FROM hits", HITS)
ORACLES["attack_categories_in_pages"] = f"""
SELECT page_id, category FROM (SELECT page_id, unnest({signature_sql('html')}) AS category FROM pages)
WHERE category IS NOT NULL"""
ORACLES["web_attacks"] = over("""
SELECT job_id, source_ip, severity, title, n AS attempt_count, sample_lines, sample_endpoints FROM web_alerts""", HITS)

RATES = """
rolled AS (
  SELECT job_id, source_ip, event_time, line_number,
    count(*) OVER w AS rate, min(event_time) OVER w AS start_ts
  FROM fx WINDOW w AS (PARTITION BY job_id, source_ip ORDER BY event_time
    RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)),
rates AS (
  SELECT job_id, source_ip, rate, start_ts, event_time AS end_ts,
    count(*) OVER (PARTITION BY job_id, source_ip) AS total
  FROM rolled QUALIFY row_number() OVER (PARTITION BY job_id, source_ip ORDER BY rate DESC, event_time) = 1),
rate_alerts AS (
  SELECT *, CASE WHEN rate >= 500 THEN 'critical' WHEN rate >= 300 THEN 'high' ELSE 'medium' END AS severity
  FROM rates WHERE rate >= 7)"""
ORACLES["rate_abuse"] = over(f"""
SELECT job_id, source_ip, severity, rate AS peak_rate_per_minute, total AS total_requests,
  {ts('start_ts')} AS window_start, {ts('end_ts')} AS window_end
FROM rate_alerts""", RATES)

EXFIL = """
heavy AS (
  SELECT job_id, source_ip, CAST(sum(response_size) AS BIGINT) AS bytes, count(*) AS requests
  FROM fx WHERE response_size <> 0 GROUP BY 1, 2 HAVING sum(response_size) >= 250 * 1048576),
tops AS (
  SELECT job_id, source_ip, endpoint, CAST(sum(response_size) AS BIGINT) AS b,
    row_number() OVER (PARTITION BY job_id, source_ip ORDER BY sum(response_size) DESC, min(line_number)) AS place
  FROM fx WHERE response_size <> 0 AND endpoint IS NOT NULL GROUP BY 1, 2, 3),
exfil AS (
  SELECT h.job_id, h.source_ip, any_value(h.bytes) AS bytes, any_value(h.requests) AS requests,
    any_value(h.bytes) / 1048576 AS mb,
    string_agg(t.endpoint || '=' || t.b, ',' ORDER BY t.place) FILTER (WHERE t.place <= 5) AS top5,
    string_agg(t.endpoint, ', ' ORDER BY t.place) FILTER (WHERE t.place <= 3) AS top3,
    '[' || coalesce(string_agg('{"endpoint":"' || t.endpoint || '","bytes":' || t.b || '}', ',' ORDER BY t.place)
      FILTER (WHERE t.place <= 5), '') || ']' AS top_json
  FROM heavy h LEFT JOIN tops t ON t.job_id = h.job_id AND t.source_ip = h.source_ip GROUP BY 1, 2),
exfil_alerts AS (
  SELECT *, CASE WHEN mb >= 500 THEN 'critical' WHEN mb >= 200 THEN 'high' ELSE 'medium' END AS severity,
    'Possible Data Exfiltration by ' || source_ip AS title,
    'IP ' || source_ip || ' downloaded ' || format('{:.1f}', round_even(mb, 1)) || ' MB of data across ' || requests
      || ' requests. Top endpoints: ' || coalesce(top3, '') AS description
  FROM exfil)"""
ORACLES["exfiltration"] = over("""
SELECT job_id, source_ip, severity, description, bytes AS total_bytes, round_even(mb, 1) AS total_mb,
  requests AS request_count, coalesce(top5, '') AS top_endpoints
FROM exfil_alerts""", EXFIL)

FLOOD = """
per_status AS (SELECT job_id, source_ip, status_code, count(*) AS n FROM fx WHERE status_code >= 400 GROUP BY 1, 2, 3),
flood AS (
  SELECT job_id, source_ip, CAST(sum(n) AS BIGINT) AS errors,
    CAST(sum(CASE WHEN status_code < 500 THEN n ELSE 0 END) AS BIGINT) AS client,
    CAST(sum(CASE WHEN status_code >= 500 THEN n ELSE 0 END) AS BIGINT) AS server,
    '{' || string_agg('"' || status_code || '":' || n, ',' ORDER BY status_code) || '}' AS by_status
  FROM per_status GROUP BY 1, 2),
flood_alerts AS (
  SELECT *, 'medium' AS severity, 'Excessive Client Errors from ' || source_ip AS title,
    'IP ' || source_ip || ' generated ' || client || ' client errors (4xx) and ' || server
      || ' server errors (5xx). This may indicate directory brute-forcing or vulnerability scanning.' AS description
  FROM flood WHERE errors >= 10 AND client >= 10)"""
ORACLES["error_flood"] = over("""
SELECT job_id, source_ip, severity, description, errors AS total_errors, by_status AS status_distribution
FROM flood_alerts""", FLOOD)

RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1"
ORACLES["all_detectors"] = over(f"""
SELECT job_id, detector, alert_type, severity, CAST({RANK} AS INTEGER) AS severity_rank, source_ip, title FROM (
  SELECT job_id, 'brute_force' AS detector, 'brute_force' AS alert_type, severity, source_ip,
    'Brute Force Attack from ' || source_ip AS title FROM brute_alerts
  UNION ALL SELECT job_id, 'off_hours_login', 'suspicious_login', 'high', source_ip,
    'Privileged Account Login Outside Working Hours' FROM off_hours
  UNION ALL SELECT job_id, 'multi_privileged', 'privilege_escalation', 'critical', source_ip,
    'Multiple Privileged Account Access from ' || source_ip FROM multi
  UNION ALL SELECT job_id, 'login_after_failures', 'suspicious_login', 'high', source_ip,
    'Successful Login After ' || streak || ' Failures for ''' || username || '''' FROM streaks
  UNION ALL SELECT job_id, 'web_attacks', 'web_attack', severity, source_ip, title FROM web_alerts
  UNION ALL SELECT job_id, 'rate_abuse', 'api_abuse', severity, source_ip, 'API Rate Abuse from ' || source_ip FROM rate_alerts
  UNION ALL SELECT job_id, 'exfiltration', 'data_exfiltration', severity, source_ip, title FROM exfil_alerts
  UNION ALL SELECT job_id, 'error_flood', 'api_abuse', severity, source_ip, title FROM flood_alerts)""",
  BURSTS, OFF_HOURS, MULTI, STREAKS, HITS, RATES, EXFIL, FLOOD)

# --- alerts of all detectors -----------------------------------------------------------------
def quoted_list(column):
    """A list of names, joined with a comma and a blank, as JSON."""
    return f"""'["' || replace({column}, ', ', '", "') || '"]'"""


ALERTS = f"""
al AS (
  SELECT *, CAST({RANK} AS INTEGER) AS severity_rank,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(10 * order_line) AS created_at FROM (
    SELECT job_id, 'brute_force' AS detector, 0 AS detector_order, 'brute_force' AS alert_type, severity, source_ip,
      'Brute Force Attack from ' || source_ip AS title,
      'Detected ' || failed_attempts || ' failed login attempts from IP ' || source_ip || ' within '
        || CAST(round_even((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6, 0) AS BIGINT) || ' seconds. Target accounts: '
        || coalesce(target_account, 'unknown') || '.' || CASE WHEN success
        THEN ' A SUCCESSFUL LOGIN was detected after the failures — possible credential compromise!' ELSE '' END AS description,
      (SELECT min(line_number) FROM fails f WHERE f.job_id = a.job_id AND f.source_ip = a.source_ip) AS order_line,
      target_account,
      '{{"failed_attempts": ' || failed_attempts || ', "duration_seconds": ' || (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6
        || ', "target_accounts": ' || coalesce({quoted_list('target_account')}, '[]') || ', "first_attempt": "' || {ts('first_ts')}
        || '", "last_attempt": "' || {ts('last_ts')} || '", "success_after_failures": ' || success
        || ', "sample_lines": [' || replace(sample_lines, ',', ', ') || ']}}' AS evidence,
      ['Block IP address ' || source_ip || ' immediately',
        CASE WHEN target_account IS NULL THEN 'Review targeted accounts' ELSE 'Reset passwords for targeted accounts' END,
        'Enable account lockout policies', 'Enable multi-factor authentication',
        CASE WHEN success THEN 'Review successful login sessions from this IP' ELSE 'Monitor for successful login attempts' END] AS actions
    FROM brute_alerts a
    UNION ALL SELECT job_id, 'off_hours_login', 1, 'suspicious_login', 'high', source_ip,
      'Privileged Account Login Outside Working Hours',
      'User ''' || username || ''' logged in at ' || strftime(event_time, '%H:%M:%S')
        || ' (outside 6:00-22:00 working hours) from IP ' || source_ip || '. This may indicate unauthorized access.',
      line_number, username,
      '{{"login_time": "' || {ts('event_time')} || '", "hour": ' || hour(event_time) || ', "account": "' || username
        || '", "source_ip": "' || source_ip || '", "line_number": ' || line_number || '}}',
      ['Verify this login was authorized by the ' || username || ' account owner',
        'Check for any lateral movement or privilege escalation', 'Review session activity following this login',
        'Consider restricting privileged account access to working hours'] FROM off_hours
    UNION ALL SELECT job_id, 'multi_privileged', 2, 'privilege_escalation', 'critical', source_ip,
      'Multiple Privileged Account Access from ' || source_ip,
      'IP ' || source_ip || ' accessed ' || accounts || ' privileged accounts: ' || names
        || '. This may indicate credential stuffing or lateral movement.',
      (SELECT min(line_number) FROM fx f WHERE f.job_id = a.job_id AND f.source_ip = a.source_ip
        AND f.event_type IN {among(fixed.PRIVILEGED_USE_TYPES)} AND lower(f.username) IN {PRIVILEGED}), names,
      '{{"accounts": ' || {quoted_list('names')} || ', "login_count": ' || login_count || ', "source_ip": "' || source_ip || '"}}',
      ['Block IP ' || source_ip || ' and investigate source', 'Reset passwords for all affected privileged accounts',
        'Audit all actions taken by these accounts', 'Enable MFA for all privileged accounts'] FROM multi a
    UNION ALL SELECT job_id, 'login_after_failures', 3, 'suspicious_login', 'high', source_ip,
      'Successful Login After ' || streak || ' Failures for ''' || username || '''',
      'Account ''' || username || ''' had ' || streak || ' consecutive failed login attempts before a successful login at '
        || {ts('event_time')} || '. This may indicate a successful brute-force or credential guessing attack.',
      line_number, username,
      '{{"failure_count": ' || streak || ', "success_time": "' || {ts('event_time')} || '", "success_ip": "' || source_ip
        || '", "line_number": ' || line_number || '}}',
      ['Immediately investigate the session for user ''' || username || '''', 'Force password reset for this account',
        'Check for data access or lateral movement', 'Enable MFA if not already enabled'] FROM streaks
    UNION ALL SELECT job_id, 'web_attacks', 4, 'web_attack', severity, source_ip, title,
      'Detected ' || n || ' ' || lower(category) || ' attempt(s) from IP ' || source_ip || '. Sample targets: '
        || array_to_string(string_split(sample_endpoints, '|')[1:3], ', '),
      (SELECT min(line_number) FROM hits h WHERE h.job_id = a.job_id AND h.source_ip = a.source_ip
        AND h.category = a.category), NULL,
      '{{"attack_type": "' || category || '", "attempt_count": ' || n || ', "source_ip": "' || source_ip
        || '", "sample_endpoints": ["' || replace(sample_endpoints, '|', '", "') || '"], "sample_lines": ['
        || replace(sample_lines, ',', ', ') || ']}}',
      ['Block IP ' || source_ip || ' at WAF/firewall level', 'Review all requests from ' || source_ip || ' for successful exploitation',
        'Check application logs for signs of data breach', 'Update WAF rules to block ' || lower(category) || ' patterns',
        'Ensure input validation and parameterized queries are in place'] FROM web_alerts a
    UNION ALL SELECT job_id, 'rate_abuse', 5, 'api_abuse', severity, source_ip, 'API Rate Abuse from ' || source_ip,
      'IP ' || source_ip || ' made ' || rate || ' requests per minute (threshold: 7/min). Peak window: ' || {ts('start_ts')}
        || ' to ' || {ts('end_ts')} || '.',
      (SELECT min(line_number) FROM fx f WHERE f.job_id = a.job_id AND f.source_ip = a.source_ip), NULL,
      '{{"peak_rate_per_minute": ' || rate || ', "total_requests": ' || total || ', "window_start": "' || {ts('start_ts')}
        || '", "window_end": "' || {ts('end_ts')} || '"}}',
      ['Apply rate limiting to IP ' || source_ip, 'Implement API throttling at the gateway level',
        'Consider CAPTCHA or proof-of-work challenges', 'Check if this is a DDoS pattern'] FROM rate_alerts a
    UNION ALL SELECT job_id, 'exfiltration', 6, 'data_exfiltration', severity, source_ip, title, description,
      (SELECT min(line_number) FROM fx f WHERE f.job_id = a.job_id AND f.source_ip = a.source_ip
        AND f.response_size <> 0), NULL,
      '{{"total_bytes": ' || bytes || ', "total_mb": ' || round_even(mb, 1) || ', "request_count": ' || requests
        || ', "top_endpoints": ' || replace(replace(replace(top_json, ',"', ', "'), '":', '": '), '}},{{', '}}, {{') || '}}',
      ['Investigate what data IP ' || source_ip || ' accessed', 'Check for sensitive data in transferred content',
        'Review access controls on data endpoints', 'Consider data loss prevention (DLP) controls'] FROM exfil_alerts a
    UNION ALL SELECT job_id, 'error_flood', 7, 'api_abuse', severity, source_ip, title, description,
      (SELECT min(line_number) FROM fx f WHERE f.job_id = a.job_id AND f.source_ip = a.source_ip
        AND f.status_code >= 400), NULL,
      '{{"4xx_count": ' || client || ', "5xx_count": ' || server || ', "status_distribution": '
        || replace(replace(by_status, ',"', ', "'), '":', '": ') || ', "total_errors": ' || errors || '}}',
      ['Block or rate-limit IP ' || source_ip, 'Review error patterns for reconnaissance activity',
        'Ensure sensitive paths return generic responses'] FROM flood_alerts a)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY severity_rank DESC, detector_order, order_line, title, source_ip, description) AS number FROM al)"""
JOBS = """
jb AS (
  SELECT job_id, job_id || '.log' AS filename, CAST(sum(response_size) AS BIGINT) AS file_size, 'Mixed' AS log_type,
    'completed' AS status, count(*) AS total_lines, count(*) AS parsed_lines,
    'owner' || (CAST(regexp_extract(job_id, '([0-9]+)', 1) AS INTEGER) % 2) AS created_by_user_id, min(event_time) AS created_at
  FROM fx GROUP BY job_id)"""
WITH_ALERTS = (BURSTS, OFF_HOURS, MULTI, STREAKS, HITS, RATES, EXFIL, FLOOD, ALERTS)
ORACLES["stored_alerts"] = over(f"""
SELECT job_id, detector, severity, source_ip, target_account, title, description, {sec('created_at')} AS created_at,
  array_to_string(actions, '|') AS actions FROM al""", *WITH_ALERTS)
ORACLES["alerts_by_severity"] = over(
    "SELECT job_id, severity, count(*) AS count FROM al GROUP BY 1, 2", *WITH_ALERTS)
ORACLES["alerts_by_type"] = over(
    "SELECT job_id, alert_type, count(*) AS count FROM al GROUP BY 1, 2", *WITH_ALERTS)


# entries of access logs and CSV exports, as the detectors see them: the same SQL over another table
def detected(entries):
    """The detectors' CTEs over the entries ``ac`` that a CTE selects."""
    return [entries, *(re.sub(r"\bfxm?\b", "ac", c) for c in WITH_ALERTS)]


ACCESS_ENTRIES = f"""
SELECT event_id, event_id + 1 AS line_number, date_trunc('second', event_time) AS event_time, source_ip, username,
  path AS endpoint, method || ' ' || path || ' -> ' || status_code AS message, {_class} AS event_type, status_code,
  response_size FROM pa"""
ORACLES["analyzed_files"] = over(f"""
SELECT 'entries' AS kind, {_class} || ' whole' AS name, count(*) AS n FROM pa GROUP BY 2
UNION ALL
SELECT 'entries', waf_type || CASE WHEN line_number % 10 = 0 THEN ' broken' ELSE ' whole' END, count(*) FROM wf GROUP BY 2
UNION ALL SELECT 'alerts', severity || ' ' || title, count(*) FROM al GROUP BY 2
UNION ALL SELECT 'lines', 'Mixed', 2 * count(*) FROM fx
UNION ALL SELECT 'parsed', 'all', 2 * count(*) FROM fx""", PATH, WAF, *detected(f"""
ac AS (
  SELECT 'all' AS job_id, * FROM ({ACCESS_ENTRIES} UNION ALL
    SELECT event_id, line_number, date_trunc('second', event_time), source_ip, NULL,
      CASE WHEN line_number % 10 = 0 THEN '/' || coalesce(endpoint, '') || chr(10) || ',' || line_number ELSE endpoint END, waf_message, waf_type,
      NULL, NULL FROM wm))"""))
LEVELS = "lv AS (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity)"
ORACLES["severity_distribution"] = over("""
SELECT jb.job_id, lv.severity, count(al.title) AS count
FROM jb CROSS JOIN lv LEFT JOIN al ON al.job_id = jb.job_id AND al.severity = lv.severity GROUP BY 1, 2""",
  *WITH_ALERTS, JOBS, LEVELS)

# --- dashboard --------------------------------------------------------------------------
WAF_TYPES = among(fixed.WAF_TYPES)
PERCENT = "round_even(count(CASE WHEN status_code >= 400 THEN 1 END) / count(*) * 100, 2)"
ORACLES["dash_scalars"] = over(f"""
SELECT job_id, count(*) AS total_events, count(DISTINCT source_ip) AS unique_ips,
  count(CASE WHEN event_type = 'login_failed' THEN 1 END) AS failed_logins,
  count(CASE WHEN event_type = 'login_success' THEN 1 END) AS successful_logins,
  {PERCENT} AS error_rate, count(CASE WHEN event_type IN {WAF_TYPES} THEN 1 END) > 0 AS waf_has_data
FROM fx GROUP BY job_id""")


def top(value, name, k, condition="true", cut=None):
    return f"""
SELECT job_id, {cut or 'v'} AS {name}, n AS count FROM (
  SELECT job_id, {value} AS v, count(*) AS n,
    row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, {value}) AS place
  FROM fx WHERE {value} IS NOT NULL AND {condition} GROUP BY 1, 2) WHERE place <= {k}"""


TOPS = {
    "top_ips": ("source_ip", "ip", 10),
    "top_endpoints": ("endpoint", "endpoint", 10),
    "top_users": ("username", "username", 10),
    "top_blocked_ips": ("source_ip", "ip", 10, "event_type = 'waf_block'"),
    "top_blocked_endpoints": ("endpoint", "endpoint", 10, "event_type = 'waf_block'"),
    "top_rules": ("rule", "rule", 15, f"event_type IN {WAF_TYPES} AND rule <> ''", "right(v, 120)"),
}
for _name, _args in TOPS.items():
    ORACLES[_name] = over(top(*_args))
ORACLES["events_by_hour"] = over(
    "SELECT job_id, CAST(hour(event_time) AS INTEGER) AS hour, count(*) AS count FROM fx GROUP BY 1, 2")
ORACLES["waf_actions"] = over(f"""
SELECT job_id, upper(substr(event_type, 5)) AS action, count(*) AS count FROM fx WHERE event_type IN {WAF_TYPES} GROUP BY 1, 2""")
WAF_HOURS = f"""
wh AS (
  SELECT j.job_id, CAST(h.hour AS INTEGER) AS hour, count(f.event_type) AS total,
    count(CASE WHEN f.event_type = 'waf_block' THEN 1 END) AS blocked,
    count(CASE WHEN f.event_type = 'waf_allow' THEN 1 END) AS allowed,
    count(CASE WHEN f.event_type = 'waf_count' THEN 1 END) AS counted
  FROM (SELECT DISTINCT job_id FROM fx) j CROSS JOIN (SELECT unnest(range(24)) AS hour) h
  LEFT JOIN fx f ON f.job_id = j.job_id AND hour(f.event_time) = h.hour AND f.event_type IN {WAF_TYPES}
  GROUP BY 1, 2)"""
ORACLES["waf_by_hour"] = over("SELECT * FROM wh", WAF_HOURS)


def listed(query_name, value):
    inner = top(*TOPS[query_name])
    return (
        f"coalesce((SELECT string_agg({value} || ':' || count, ',' ORDER BY count DESC, {value}) "
        f"FROM ({inner}) t WHERE t.job_id = s.job_id), '')"
    )


def level_count(level):
    return f"(SELECT count(*) FROM al WHERE al.job_id = s.job_id AND severity = '{level}')"


ORACLES["dashboard"] = over(f"""
SELECT s.job_id, s.total_events, (SELECT count(*) FROM al WHERE al.job_id = s.job_id) AS total_alerts,
  {level_count('critical')} AS critical_alerts, {level_count('high')} AS high_alerts,
  {level_count('medium')} AS medium_alerts, {level_count('low')} AS low_alerts,
  s.unique_ips, s.failed_logins, s.successful_logins, s.error_rate,
  {listed('top_ips', 'ip')} AS top_source_ips, {listed('top_endpoints', 'endpoint')} AS top_endpoints,
  {listed('top_users', 'username')} AS top_usernames, {listed('top_blocked_ips', 'ip')} AS top_blocked_ips,
  {listed('top_blocked_endpoints', 'endpoint')} AS top_blocked_endpoints,
  {listed('top_rules', 'rule')} AS top_terminating_rules,
  (SELECT string_agg(h || ':' || n, ',' ORDER BY h) FROM (SELECT hour(event_time) AS h, count(*) AS n FROM fx
    WHERE fx.job_id = s.job_id GROUP BY 1)) AS events_by_hour,
  coalesce((SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT alert_type AS t, count(*) AS n FROM al
    WHERE al.job_id = s.job_id GROUP BY 1)), '') AS alerts_by_type,
  'info:0,low:' || {level_count('low')} || ',medium:' || {level_count('medium')} || ',high:' || {level_count('high')}
    || ',critical:' || {level_count('critical')} AS severity_distribution,
  s.waf_has_data,
  (SELECT string_agg(a || ':' || n, ',' ORDER BY n DESC, a) FROM (SELECT upper(substr(event_type, 5)) AS a, count(*) AS n FROM fx
    WHERE fx.job_id = s.job_id AND event_type IN {WAF_TYPES} GROUP BY 1)) AS waf_action_counts,
  (SELECT string_agg(hour || ':' || total || ':' || blocked || ':' || allowed || ':' || counted, ',' ORDER BY hour)
    FROM wh WHERE wh.job_id = s.job_id) AS waf_events_by_hour
FROM (
  SELECT job_id, count(*) AS total_events, count(DISTINCT source_ip) AS unique_ips,
    count(CASE WHEN event_type = 'login_failed' THEN 1 END) AS failed_logins,
    count(CASE WHEN event_type = 'login_success' THEN 1 END) AS successful_logins,
    {PERCENT} AS error_rate, count(CASE WHEN event_type IN {WAF_TYPES} THEN 1 END) > 0 AS waf_has_data
  FROM fx GROUP BY job_id) s""", *WITH_ALERTS, WAF_HOURS)

ORACLES["dashboard_from_rollups"] = ORACLES["dashboard"]
ORACLES["estimated_addresses"] = over("""
SELECT job_id, count(DISTINCT source_ip) AS unique_ips, true AS within_bound FROM fx GROUP BY job_id""")

# --- search, alerts, jobs, time line ----------------------------------------------------------
ORACLES["search_entries"] = over("""
SELECT job_id, line_number, message, username FROM fxm
WHERE event_type = 'login_failed' AND message ILIKE '%API%error%' ORDER BY line_number, job_id LIMIT 50 OFFSET 50""")
ORACLES["search_deep_page"] = over("""
SELECT job_id, line_number, message FROM fxm WHERE message ILIKE '%api%' ORDER BY line_number, job_id LIMIT 50 OFFSET 2950""")
ORACLES["search_count"] = over(
    "SELECT count(*) AS total FROM fxm WHERE username = 'root' AND message ILIKE '%get _api%'")
ORACLES["list_alerts"] = over(f"""
SELECT al.job_id, severity, title, source_ip, {sec('al.created_at')} AS created_at
FROM al JOIN jb ON jb.job_id = al.job_id WHERE severity = 'high' AND created_by_user_id = 'owner0'""", *WITH_ALERTS, JOBS)
ORACLES["alert_total"] = over("""
SELECT count(*) AS total FROM al JOIN jb ON jb.job_id = al.job_id
WHERE severity = 'high' AND created_by_user_id = 'owner0'""", *WITH_ALERTS, JOBS)
ORACLES["job_total"] = over("SELECT count(*) AS total FROM jb WHERE created_by_user_id = 'owner1'", JOBS)
ORACLES["filter_alerts"] = over(
    "SELECT job_id, alert_type, title FROM al WHERE severity = 'exfil' OR contains(alert_type, 'exfil')", *WITH_ALERTS)
ORACLES["list_jobs"] = over(f"""
SELECT job_id, filename, file_size, log_type, status, total_lines, parsed_lines, created_by_user_id,
  {ts('created_at')} AS created_at, (SELECT count(*) FROM al WHERE al.job_id = jb.job_id) AS alert_count
FROM jb ORDER BY jb.created_at DESC, job_id LIMIT 2""", *WITH_ALERTS, JOBS)
ORACLES["scope_to_owner"] = over(
    "SELECT job_id, created_by_user_id FROM jb WHERE created_by_user_id = 'owner1'", JOBS)
TIMELINE = f"""
tl0 AS (
  SELECT job_id, event_time AS timestamp, event_type, source_ip, username,
    coalesce(nullif(message, ''), event_type || ' event') AS description,
    CASE WHEN event_type IN ('login_failed', 'invalid_user') THEN 'low'
      WHEN event_type IN ('unauthorized', 'forbidden', 'firewall_block') THEN 'medium'
      WHEN event_type = 'server_error' THEN 'high' END AS severity, 0 AS origin, 0 AS down, 0 AS det, line_number AS line
  FROM fxm WHERE event_type IN {among(fixed.TIMELINE_TYPES)}
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_time, line_number) <= 200
  UNION ALL
  SELECT job_id, created_at, 'alert_' || alert_type, source_ip, target_account, title, severity, 1, -severity_rank, detector_order, order_line
  FROM al),
tl AS (
  SELECT job_id, timestamp, event_type, source_ip, username, description, severity,
    CAST(row_number() OVER (PARTITION BY job_id ORDER BY timestamp, origin, down, det, line, description, source_ip) AS INTEGER) AS place,
    count(*) OVER (PARTITION BY job_id) AS total
  FROM tl0 QUALIFY place <= 200)"""
ORACLES["timeline_events"] = over(f"""
SELECT job_id, {ts('timestamp')} AS timestamp, event_type, source_ip, username, description, severity, place, total
FROM tl""", *WITH_ALERTS, TIMELINE)
ORACLES["timeline_event_types"] = over("SELECT DISTINCT event_type FROM tl", *WITH_ALERTS, TIMELINE)
ORACLES["timeline_of_type"] = over(
    "SELECT job_id, place, username FROM tl WHERE event_type = 'invalid_user'", *WITH_ALERTS, TIMELINE)

# --- evidence and risk -----------------------------------------------------------------------------
EVIDENCE = f"""
types AS (
  SELECT job_id, event_type, count(*) AS count,
    CAST(row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, event_type) AS INTEGER) AS place
  FROM fx GROUP BY 1, 2 QUALIFY place <= 15),
notable AS (
  SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY line_number) AS INTEGER) AS number, line_number,
    '  Line ' || line_number || ': [' || {ts('event_time')} || '] ' || event_type || ' | IP: ' || source_ip
      || ' | User: ' || coalesce(username, 'N/A') || ' | ' || left(message, 150) AS text
  FROM fxm WHERE event_type IN {among(fixed.NOTABLE_TYPES)} QUALIFY number <= 30),
digest AS (
  SELECT job_id, number, chr(10) || 'Alert #' || number || ': [' || upper(severity) || '] ' || title || chr(10) || '  Type: '
    || alert_type || chr(10) || '  Description: ' || description || chr(10) || '  Source IP: ' || source_ip || chr(10)
    || coalesce('  Target Account: ' || target_account || chr(10), '') || '  Evidence: ' || left(evidence, 500) AS text
  FROM numbered)"""
ORACLES["event_type_distribution"] = over("SELECT job_id, place, event_type, count FROM types", *WITH_ALERTS, EVIDENCE)
ORACLES["alert_digest"] = over("SELECT job_id, number, text FROM digest", *WITH_ALERTS, EVIDENCE)
ORACLES["notable_sample"] = over("SELECT job_id, number, line_number, text FROM notable", *WITH_ALERTS, EVIDENCE)


def _counted(query_name, value):
    inner = top(*TOPS[query_name])
    return (
        f"(SELECT string_agg('  ' || {value} || ': ' || count || ' events', chr(10) ORDER BY count DESC, {value}) "
        f"FROM ({inner}) t WHERE t.job_id = s.job_id)"
    )


ORACLES["evidence_pack"] = over(f"""
SELECT s.job_id, p.part, concat_ws(chr(10),
  CASE WHEN p.part = 0 THEN concat_ws(chr(10),
    'Log Type: Mixed', 'Total Log Entries: ' || s.n, '', 'Event Type Distribution:',
    (SELECT string_agg('  ' || event_type || ': ' || count, chr(10) ORDER BY place) FROM types t WHERE t.job_id = s.job_id),
    '', 'Top Source IPs:', {_counted('top_ips', 'ip')}, '', 'Top Usernames:', {_counted('top_users', 'username')},
    CASE WHEN s.alerts > 0 THEN chr(10) || '--- SECURITY ALERTS (' || s.alerts || ') ---' END) END,
  (SELECT string_agg(text, chr(10) ORDER BY number) FROM digest d WHERE d.job_id = s.job_id AND (d.number - 1) // 1000 = p.part),
  CASE WHEN p.part = greatest(s.alerts - 1, 0) // 1000 THEN chr(10) || '--- SAMPLE NOTABLE ENTRIES ('
    || (SELECT count(*) FROM notable o WHERE o.job_id = s.job_id) || ') ---' || chr(10)
    || (SELECT string_agg(text, chr(10) ORDER BY number) FROM notable o WHERE o.job_id = s.job_id) END) AS text
FROM (SELECT job_id, count(*) AS n, (SELECT count(*) FROM al WHERE al.job_id = fx.job_id) AS alerts FROM fx GROUP BY job_id) s,
  LATERAL (SELECT unnest(range(greatest(s.alerts - 1, 0) // 1000 + 1)) AS part) p""", *WITH_ALERTS, EVIDENCE)
ORACLES["job_risk"] = over("""
SELECT jb.job_id, coalesce((SELECT arg_max(severity, severity_rank) FROM al WHERE al.job_id = jb.job_id), 'info') AS risk_level
FROM jb""", *WITH_ALERTS, JOBS)
ORACLES["job_recommendations"] = over("""
SELECT job_id, number AS alert_number, CAST(u.i AS INTEGER) AS action_number, actions[u.i] AS action
FROM numbered n, LATERAL (SELECT unnest(range(1, len(n.actions) + 1)) AS i) u""", *WITH_ALERTS)

# --- reputation ----------------------------------------------------------------------------------------
PUBLIC = """
pe AS (
  SELECT event_id, user_id, event_time,
    CASE WHEN k % 2 = 0 THEN '8.8.' ELSE '10.0.' END || (user_id // 256) || '.' || (user_id % 256) AS ip FROM fx),
ab AS (
  SELECT ip, CAST(max(user_id) % 101 AS INTEGER) AS score, CAST(count(*) AS INTEGER) AS reports, max(event_time) AS checked_at
  FROM pe WHERE ip LIKE '8.8.%' GROUP BY ip),
vt AS (
  SELECT ip, CAST(max(user_id) % 7 AS INTEGER) AS malicious, max(user_id) % 10 = 4 AS missing, max(event_time) AS checked_at
  FROM pe WHERE ip LIKE '8.8.%' AND user_id % 2 = 0 GROUP BY ip)"""
ORACLES["public_addresses"] = over("SELECT DISTINCT ip FROM pe WHERE ip LIKE '8.8.%'", PUBLIC)
ORACLES["public_address_tests"] = over("""
SELECT event_id, a || '.' || b || '.' || c || '.' || d AS ip,
  NOT (a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
    OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10))
    OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
    OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public
FROM (SELECT event_id, event_id % 256 AS a, (event_id * 7 + k) % 256 AS b, k % 5 AS c, user_id % 256 AS d FROM fx)""")
LIMIT = "checked_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 86400 SECONDS"
ORACLES["enriched_addresses"] = over(f"""
SELECT p.ip, ab.score, ab.reports, CASE WHEN vt.missing THEN 0 ELSE vt.malicious END AS malicious,
  CASE WHEN vt.ip IS NOT NULL THEN CAST(0 AS INTEGER) END AS harmless
FROM (SELECT DISTINCT ip FROM pe WHERE ip LIKE '8.8.%') p
LEFT JOIN (SELECT * FROM ab WHERE {LIMIT}) ab ON ab.ip = p.ip
LEFT JOIN (SELECT * FROM vt WHERE {LIMIT}) vt ON vt.ip = p.ip""", PUBLIC)
ORACLES["reputation_at_event"] = over("""
SELECT e.event_id, CASE WHEN e.event_time - r.checked_at <= INTERVAL 86400 SECONDS THEN r.score END AS score
FROM pe e ASOF LEFT JOIN (
  SELECT ip, event_time AS checked_at, max(event_id % 101) AS score FROM pe WHERE event_id % 7 = 0 GROUP BY 1, 2
) r ON e.ip = r.ip AND e.event_time >= r.checked_at""", PUBLIC)
ORACLES["reputation_bands"] = over("""
SELECT CASE WHEN score >= 75 THEN 'red' WHEN score >= 25 THEN 'amber' ELSE 'green' END AS band, count(*) AS addresses
FROM ab GROUP BY 1""", PUBLIC)

# --- streaming --------------------------------------------------------------------------------------------
ORACLES["ingested_stream"] = over(f"""
SELECT {_class} AS event_type, method, count(*) AS entries, CAST(sum(response_size) AS BIGINT) AS bytes FROM pa GROUP BY 1, 2""", PATH)
ORACLES["ingested_alerts"] = over("""
SELECT detector, source_ip, count(*) AS jobs FROM (
  SELECT 'exfiltration' AS detector, source_ip FROM fx
  GROUP BY source_ip, event_id // 200 HAVING sum(response_size) >= 10 * 1048576
  UNION ALL
  SELECT 'error_flood', source_ip FROM fx
  GROUP BY source_ip, event_id // 200 HAVING count(*) FILTER (status_code BETWEEN 400 AND 499) >= 2
  UNION ALL SELECT 'web_attacks', source_ip FROM (SELECT DISTINCT source_ip, job_id FROM hits))
GROUP BY 1, 2""", PATH, *detected(f"ac AS (SELECT event_id // 200 AS job_id, * FROM ({ACCESS_ENTRIES}))"))
ORACLES["streamed_rate"] = over(f"""
SELECT job_id, source_ip, {sec('w')} AS window_start, count(*) AS requests FROM (
  SELECT job_id, source_ip, unnest([time_bucket(INTERVAL 12 HOURS, event_time, TIMESTAMP '1970-01-01 00:00:00'),
    time_bucket(INTERVAL 12 HOURS, event_time, TIMESTAMP '1970-01-01 00:00:00') - INTERVAL 12 HOURS]) AS w FROM fx)
GROUP BY 1, 2, 3""")
