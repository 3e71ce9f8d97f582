"""Log parser queries (S04, T12-T16, P03, B07) over the derived log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions import logs as lg
from ticketweave.operators import rules as ru
from ticketweave.plans.q_text import LEVEL_SQL, MSG_SQL, UPSTREAM_SQL
from ticketweave.plans.registry import query
from ticketweave.plans.sqlkit import case, q, table_map, union_found

C, L = F.col, F.lit
CODES = lambda e: f"list_sort(list_distinct({union_found(e, fv.ERROR_CODE_PATTERNS['log'])}))"
STAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
TS = f"coalesce(nullif(regexp_extract(line, {q(STAMP)}, 1), ''), nullif(regexp_extract(line, '(\\d{{2}}/\\w{{3}}/\\d{{4}}:\\d{{2}}:\\d{{2}}:\\d{{2}})', 1), ''), nullif(regexp_extract(line, '(\\w{{3}}\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})', 1), ''))"
J = lambda k: f"nullif(json_extract_string(line, '$.{k}'), '')"
EVENT = ["line_id", "ts_text", "level", "service", "error_code", "endpoint", "log_user", "message", "upstream_system", "duration_ms", "codes"]


def _event(df, keep=EVENT):
    return df.withColumn("codes", F.array_join("matched_error_codes", ",")).select(*keep)


API = f"""SELECT line_id, {J('time')} AS ts_text, upper(json_extract_string(line, '$.level')) AS level, {J('service')} AS service, codes[1] AS error_code, NULL::VARCHAR AS endpoint, {J('userId')} AS log_user, msg AS message, {UPSTREAM_SQL('msg')} AS upstream_system,
 regexp_replace({J('duration_ms')}, '\\D', '', 'g')::BIGINT AS duration_ms, array_to_string(codes, ',') AS codes FROM (SELECT *, {CODES('msg')} AS codes FROM (SELECT *, json_extract_string(line, '$.msg') AS msg FROM $log_lines WHERE starts_with(line, '{{')))
UNION ALL SELECT line_id, {TS}, {LEVEL_SQL}, 'api', codes[1], NULL, NULL, trim(left(line, 500)), {UPSTREAM_SQL('line')}, NULL, array_to_string(codes, ',') FROM (SELECT *, {CODES('line')} AS codes FROM $log_lines WHERE NOT starts_with(line, '{{')) WHERE NOT ({LEVEL_SQL} = 'INFO' AND len(codes) = 0)"""


@query("s04_api_log", API)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "api"))


_HTTP = r'"[A-Z]+ (/[^"]+) HTTP/\S+"\s+(\d{3})'
HTTP = f"""SELECT line_id, {TS} AS ts_text, CASE WHEN st >= 500 THEN 'ERROR' ELSE 'WARNING' END AS level, 'nginx' AS service, st::VARCHAR AS error_code, path AS endpoint, NULL::VARCHAR AS log_user, concat('HTTP ', st, ' on ', path) AS message, NULL::VARCHAR AS upstream_system, NULL::BIGINT AS duration_ms, st::VARCHAR AS codes
 FROM (SELECT *, try_cast(regexp_extract(line, {q(_HTTP)}, 2) AS INTEGER) AS st, left(regexp_extract(line, {q(_HTTP)}, 1), 200) AS path FROM $log_lines) WHERE st >= 400"""


@query("t12_http_log", HTTP)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "http"))


DB = f"""SELECT line_id, {TS} AS ts_text, {LEVEL_SQL} AS level, 'oracle-db' AS service, o[1] AS error_code, NULL::VARCHAR AS endpoint, NULL::VARCHAR AS log_user, left(line, 500) AS message, NULL::VARCHAR AS upstream_system, NULL::BIGINT AS duration_ms, array_to_string(list_sort(list_distinct(list_transform(o, lambda x: upper(x)))), ',') AS codes
 FROM (SELECT *, regexp_extract_all(line, '(?i)ORA-\\d{{4,6}}') AS o FROM $log_lines) WHERE len(o) > 0"""


@query("t13_db_log", DB)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "database"))


GENERIC = f"""SELECT line_id, {TS} AS ts_text, lv AS level, 'unknown' AS service, codes[1] AS error_code, NULL::VARCHAR AS endpoint, NULL::VARCHAR AS log_user, left(line, 500) AS message, {UPSTREAM_SQL('line')} AS upstream_system, NULL::BIGINT AS duration_ms, array_to_string(codes, ',') AS codes
 FROM (SELECT *, {CODES('line')} AS codes, {LEVEL_SQL} AS lv FROM $log_lines) WHERE lv IN ('ERROR','FATAL','CRITICAL','WARNING') OR len(codes) > 0"""


@query("t13_generic_log", GENERIC)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "generic"))


_APP = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,.]\d+)\s+(ERROR|WARNING|WARN|INFO|DEBUG|FATAL)\s+\[([^\]]+)\]\s+\S+\s+-\s+(.+)$"
_BARE = r"^([\w.]+\.exception\.\S*Exception|java\.lang\.\S+Exception):\s*(.+)$"
_EXC = lambda e: f"coalesce(nullif(regexp_extract({e}, '(?i)[\\w.]+\\.exception\\.(?:[\\w.]*\\.)?(\\w+(?:Exception|Error))', 1), ''), {case([(f'contains({e}, {q(c)})', q(c)) for c in fv.EXCEPTION_SHORT], 'NULL')})"
_SHORT = f"coalesce({table_map(fv.EXCEPTION_SHORT)}[x], x)"
APP = f"""WITH a AS (SELECT *, nullif(regexp_extract(line, '(?s)^(/[^:]+\\.log):(.+)$', 1), '') AS f, CASE WHEN regexp_matches(line, '(?s)^/[^:]+\\.log:.+$') THEN trim(regexp_extract(line, '(?s)^(/[^:]+\\.log):(.+)$', 2)) ELSE line END AS r FROM $log_lines),
b AS (SELECT *, CASE WHEN f IS NULL THEN 'api' WHEN contains(regexp_extract(f, '([^/]+)$', 1), 'connectorCL') THEN 'connectorCL' ELSE replace(regexp_extract(f, '([^/]+)$', 1), '.log', '') END AS service FROM a),
c AS (SELECT *, left(trim(regexp_extract(r, {q(_APP)}, 4)), 500) AS m FROM b WHERE regexp_matches(r, {q(_APP)})), d AS (SELECT *, {CODES('m')} AS codes, {_EXC('m')} AS x, replace(regexp_extract(r, {q(_APP)}, 2), 'WARNING', 'WARN') AS lv FROM c),
e AS (SELECT *, {CODES('r')} AS codes, {_EXC('r')} AS x FROM b WHERE NOT regexp_matches(r, {q(_APP)}) AND regexp_matches(r, {q(_BARE)}))
SELECT line_id, regexp_extract(r, {q(_APP)}, 1) AS ts_text, lv AS level, service, coalesce(codes[1], {_SHORT}, {MSG_SQL('m')}) AS error_code, NULL::VARCHAR AS endpoint, NULL::VARCHAR AS log_user, m AS message, {UPSTREAM_SQL('m')} AS upstream_system, NULL::BIGINT AS duration_ms,
 array_to_string(CASE WHEN x IS NOT NULL THEN list_sort(list_distinct(list_append(codes, {_SHORT}))) WHEN len(codes) > 0 THEN codes ELSE list_filter([{MSG_SQL('m')}], lambda z: z IS NOT NULL) END, ',') AS codes FROM d WHERE lv IN ('ERROR','WARN','FATAL') AND NOT regexp_matches(m, {q(fv.LOG_NOISE)})
UNION ALL SELECT line_id, NULL, 'ERROR', service, coalesce({_SHORT}, codes[1], {MSG_SQL('r')}), NULL, NULL, left(r, 500), {UPSTREAM_SQL('r')}, NULL, array_to_string(CASE WHEN x IS NOT NULL THEN [{_SHORT}] WHEN len(codes) > 0 THEN codes ELSE list_filter([{MSG_SQL('r')}], lambda z: z IS NOT NULL) END, ',') FROM e"""


@query("t14_app_log", APP)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "app_error"))


_PERF = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\w+_\w+)=(\d+),(\d+)$"
PERF = f"""WITH p AS (SELECT *, try_cast(regexp_extract(line, {q(_PERF)}, 3) AS BIGINT) AS n, try_cast(regexp_extract(line, {q(_PERF)}, 4) AS BIGINT) AS total, regexp_extract(line, {q(_PERF)}, 2) AS op FROM $log_lines), a AS (SELECT *, total // greatest(n, 1) AS avg FROM p WHERE n IS NOT NULL)
SELECT line_id, regexp_extract(line, {q(_PERF)}, 1) AS ts_text, CASE WHEN avg > 10000 THEN 'ERROR' ELSE 'WARN' END AS level, upper(split_part(op, '_', 1)) AS service, CASE WHEN avg > 5000 THEN 'SLOW_CALL' ELSE 'HIGH_VOLUME' END AS error_code, NULL::VARCHAR AS endpoint, NULL::VARCHAR AS log_user,
 concat(op, ': ', n, ' appels, durée moy ', avg, 'ms (total ', total, 'ms)') AS message, upper(split_part(op, '_', 1)) AS upstream_system, avg AS duration_ms, CASE WHEN avg > 5000 THEN 'SLOW_CALL' ELSE 'HIGH_VOLUME' END AS codes FROM a WHERE avg >= 3000 OR n >= 50"""


@query("t15_perf_log", PERF)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "performance"))


TX = f"""SELECT line_id, {TS} AS ts_text, 'ERROR' AS level, 'transaction' AS service, coalesce(codes[1], 'TRANSACTION_KO') AS error_code, ti AS endpoint, NULL::VARCHAR AS log_user, concat('Transaction KO', coalesce(concat(': ', ti), '')) AS message, {UPSTREAM_SQL('line')} AS upstream_system, NULL::BIGINT AS duration_ms, array_to_string(codes, ',') AS codes
 FROM (SELECT *, {CODES('line')} AS codes, nullif(regexp_extract(line, 'titre=''([^'']+)''', 1), '') AS ti FROM $log_lines) WHERE contains(line, 'status=''KO''')"""


@query("t16_tx_log", TX)
def _(t):
    return _event(lg.parse_lines(t.log_lines, "line", "transaction"))


_PARTS = {"http": ("file_name = 'nginx.log'", HTTP), "performance": ("file_name LIKE 'solicitation%'", PERF), "database": ("file_name = 'oracle.log'", DB), "transaction": ("file_name LIKE '49mapp%'", TX), "app_error": ("file_name = 'errors_sample.log'", APP), "generic": ("file_name = 'api.log'", GENERIC)}


@query("s03_parse_by_file", " UNION ALL ".join(f"SELECT p.*, '{n}' AS strategy FROM ({sql}) p JOIN (SELECT line_id FROM $log_lines WHERE {cond}) f USING (line_id)" for n, (cond, sql) in _PARTS.items()))
def _(t):
    df = t.log_lines.filter(~lg.skipped_file(C("file_name"))).withColumn("strategy", lg.file_strategy(C("file_name")))
    return _event(lg.parse_by_strategy(df, "line", "strategy"), [*EVENT, "strategy"])


@query("p03_filter_log_noise", f"SELECT line_id FROM (SELECT *, {LEVEL_SQL} AS level FROM $log_lines) WHERE level IN ('ERROR','WARN','WARNING','FATAL','CRITICAL') AND NOT regexp_matches(concat(line, CASE WHEN user_id % 4 = 0 THEN ' Skipping commit' ELSE '' END), {q(fv.LOG_NOISE)})")
def _(t):
    from ticketweave.functions.text import log_level
    df = t.log_lines.withColumn("level", log_level("line")).withColumn("message", F.concat("line", F.when(C("user_id") % 4 == 0, " Skipping commit").otherwise("")))
    return lg.filter_log_noise(df).select("line_id")


_TYPE = case([(f"regexp_matches(lower(line), {q(p)})", q(ty)) for p, ty, _ in ru.EVENT_PATTERNS] + [("contains(lower(line), 'exception') OR contains(lower(line), 'error') OR contains(lower(line), 'erreur') OR contains(lower(line), 'failed') OR contains(lower(line), 'failure')", "'unclassified_error'")], "NULL")
_SEV = case([(f"typed = '{ty}'", f"'{s}'") for _, ty, s in ru.EVENT_PATTERNS], "'error'")


@query("b07_type_events", f"SELECT line_id, typed, {_SEV} AS severity FROM (SELECT line_id, {_TYPE} AS typed FROM $log_lines) WHERE typed IS NOT NULL")
def _(t):
    return ru.type_events(t.log_lines.select("line_id", "line"), "line").drop("line")
