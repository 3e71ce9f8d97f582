"""Log lines -> structured log events, one parser per line format.

A parser adds the event columns and keeps only the lines its format keeps. Every column depends on the line (and at
most on its codes), so plans stay shallow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions.text import error_codes, exception_class, first_match, literal_map, log_level, message_code, ts_text, upstream_system

_L, _C = F.lit, F.col
_STR = "string"
_NO_CODES = "array<string>"

_APP = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,.]\d+)\s+(ERROR|WARNING|WARN|INFO|DEBUG|FATAL)\s+\[([^\]]+)\]\s+\S+\s+-\s+(.+)$"
_BARE = r"^([\w.]+\.exception\.\S*Exception|java\.lang\.\S+Exception):\s*(.+)$"
_PREFIX = r"(?s)^(/[^:]+\.log):(.+)$"
_HTTP = r'"[A-Z]+ (/[^"]+) HTTP/\S+"\s+(\d{3})'
_PERF = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\w+_\w+)=(\d+),(\d+)$"


def file_strategy(name: Column, default: str = "generic") -> Column:
    """Parser name by file name, first rule wins."""
    return first_match([(name.rlike(p), _L(s)) for p, s in fv.FILE_STRATEGIES], _L(default))


def skipped_file(name: Column) -> Column:
    return name.rlike(fv.SKIPPED_FILES)


def _null_if_blank(c: Column) -> Column:
    return F.nullif(c, _L(""))


def _only(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(_NO_CODES))


def _event(df: DataFrame, **fields: Column) -> DataFrame:
    """Add the event columns; those a format has nothing for are null."""
    types = {"duration_ms": "long", "matched_error_codes": _NO_CODES}
    names = ["ts_text", "level", "service", "error_code", "endpoint", "log_user", "request_id", "message", "upstream_system", "duration_ms", "matched_error_codes"]
    cols = {n: fields.get(n, _L(None)).cast(types.get(n, _STR)) for n in names}
    out = df.withColumns({**cols, "raw_line": F.substring("_line", 1, 300)})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _api(df: DataFrame, service: str) -> DataFrame:
    """JSON first, with alias keys; other lines as text, where plain INFO lines without a code are dropped."""
    line = _C("_line")
    parsed = df.withColumn("_json", F.when(line.startswith("{"), F.from_json(line, "map<string,string>")))
    is_json = _C("_json").isNotNull()
    key = lambda *names: F.coalesce(*[_null_if_blank(_C("_json")[n]) for n in names])
    parsed = parsed.withColumn("_text", F.when(is_json, F.coalesce(_C("_json")["message"], _C("_json")["msg"], _L(""))).otherwise(line))
    parsed = parsed.withColumn("_codes", error_codes("_text", "log"))
    level = F.when(is_json, F.upper(F.coalesce(_C("_json")["level"], _L("INFO")))).otherwise(log_level(line))
    kept = parsed.withColumn("_level", level).filter(is_json | (_C("_level") != "INFO") | (F.size("_codes") > 0))
    digits = F.regexp_replace(F.coalesce(_C("_json")["duration_ms"], _C("_json")["durationMs"]), r"\D", "")
    return _event(
        kept, ts_text=F.when(is_json, key("timestamp", "time", "@timestamp")).otherwise(ts_text(line)), level=_C("_level"),
        service=F.coalesce(_C("_json")["service"], _L(service)), error_code=F.coalesce(key("error_code", "errorCode"), F.get("_codes", _L(0))),
        endpoint=key("endpoint", "path", "url"), log_user=key("user_id", "userId"), request_id=key("request_id", "requestId"),
        message=F.when(is_json, _C("_text")).otherwise(F.substring(line, 1, 500)), upstream_system=F.coalesce(key("upstream_system"), upstream_system("_text")),
        duration_ms=F.when(digits == "", 0).otherwise(digits.try_cast("long")), matched_error_codes=_C("_codes"))


def _http(df: DataFrame, service: str) -> DataFrame:
    """Access log lines answered with 400 or more."""
    status = _null_if_blank(F.regexp_extract("_line", _HTTP, 2)).cast("int")
    kept = df.withColumn("_status", status).filter(_C("_status") >= 400).withColumn("_path", F.substring(F.regexp_extract("_line", _HTTP, 1), 1, 200))
    code = _C("_status").cast(_STR)
    return _event(kept, ts_text=ts_text("_line"), level=F.when(_C("_status") >= 500, "ERROR").otherwise("WARNING"), service=_L("nginx"), error_code=code,
                  endpoint=_C("_path"), message=F.concat(_L("HTTP "), code, _L(" on "), _C("_path")), matched_error_codes=F.array(code))


def _database(df: DataFrame, service: str) -> DataFrame:
    """Lines naming an ORA code."""
    kept = df.withColumn("_ora", F.regexp_extract_all("_line", _L(r"(?i)ORA-\d{4,6}"), _L(0))).filter(F.size("_ora") > 0)
    return _event(kept, ts_text=ts_text("_line"), level=log_level("_line"), service=_L("oracle-db"), error_code=_C("_ora")[0], message=F.substring("_line", 1, 500),
                  matched_error_codes=F.array_sort(F.array_distinct(F.transform("_ora", lambda c: F.upper(c)))))


def _generic(df: DataFrame, service: str) -> DataFrame:
    """Anything with an error level or a code."""
    parsed = df.withColumn("_codes", error_codes("_line", "log")).withColumn("_level", log_level("_line"))
    kept = parsed.filter(_C("_level").isin("ERROR", "FATAL", "CRITICAL", "WARNING") | (F.size("_codes") > 0))
    return _event(kept, ts_text=ts_text("_line"), level=_C("_level"), service=_L("unknown"), error_code=F.get("_codes", _L(0)), message=F.substring("_line", 1, 500),
                  upstream_system=upstream_system("_line"), matched_error_codes=_C("_codes"))


def _app_error(df: DataFrame, service: str) -> DataFrame:
    """``[file:]time LEVEL [thread] class - message`` or a bare exception line; stack continuation and noise go."""
    line = _C("_line")
    cut = df.withColumn("_rest", F.when(line.rlike(_PREFIX), F.trim(F.regexp_extract(line, _PREFIX, 2))).otherwise(line))
    rest = _C("_rest")
    cut = cut.filter(rest.rlike(_APP) | rest.rlike(_BARE))
    cut = cut.withColumn("_level", F.regexp_replace(F.regexp_extract(rest, _APP, 2), "WARNING", "WARN"))
    timed = _C("_level") != ""
    cut = cut.withColumn("_text", F.when(timed, F.substring(F.trim(F.regexp_extract(rest, _APP, 4)), 1, 500)).otherwise(rest))
    cut = cut.filter(~timed | (_C("_level").isin("ERROR", "WARN", "FATAL") & ~_C("_text").rlike(fv.LOG_NOISE)))
    cut = cut.withColumns({"_codes": error_codes("_text", "log"), "_class": exception_class("_text"), "_rule": message_code("_text")})
    cut = cut.withColumn("_short", F.coalesce(F.element_at(literal_map(fv.EXCEPTION_SHORT), _C("_class")), _C("_class")))
    first, short, rule = F.get("_codes", _L(0)), _C("_short"), _C("_rule")
    name = F.regexp_extract(F.regexp_extract(line, _PREFIX, 1), r"([^/]+)$", 1)
    known = [("connectorCL", "connectorCL"), ("connectorCreationVlan", "connectorCreationVlan"), ("catalina", "tomcat-catalina"), ("transaction", "transaction")]
    of_file = first_match([(name == "", _L(service)), *[(F.contains(name, _L(k)), _L(v)) for k, v in known]], F.regexp_replace(name, r"\.log", ""))
    codes = F.when(short.isNotNull(), F.when(timed, F.array_sort(F.array_union("_codes", F.array(short)))).otherwise(F.array(short)))
    return _event(
        cut, ts_text=_null_if_blank(F.regexp_extract(rest, _APP, 1)), level=F.when(timed, _C("_level")).otherwise("ERROR"), service=of_file,
        error_code=F.when(timed, F.coalesce(first, short, rule)).otherwise(F.coalesce(short, first, rule)), message=F.substring("_text", 1, 500),
        upstream_system=upstream_system("_text"), matched_error_codes=F.coalesce(codes, F.when(F.size("_codes") > 0, _C("_codes")), _only(rule)))


def _performance(df: DataFrame, service: str) -> DataFrame:
    """``operation=count,total_ms`` lines that are slow on average or frequent."""
    part = lambda g: F.regexp_extract("_line", _PERF, g)
    p = df.filter(_C("_line").rlike(_PERF)).withColumns({"_n": part(3).try_cast("long"), "_total": part(4).try_cast("long"), "_op": part(2)})
    p = p.withColumn("_avg", F.expr("_total div greatest(_n, 1)")).filter((_C("_avg") >= 3000) | (_C("_n") >= 50))
    code, svc = F.when(_C("_avg") > 5000, "SLOW_CALL").otherwise("HIGH_VOLUME"), F.upper(F.split_part("_op", _L("_"), _L(1)))
    text = F.concat(_C("_op"), _L(": "), _C("_n"), _L(" appels, durée moy "), _C("_avg"), _L("ms (total "), _C("_total"), _L("ms)"))
    return _event(p, ts_text=part(1), level=F.when(_C("_avg") > 10000, "ERROR").otherwise("WARN"), service=svc, error_code=code, message=text, upstream_system=svc,
                  duration_ms=_C("_avg"), matched_error_codes=F.array(code))


def _transaction(df: DataFrame, service: str) -> DataFrame:
    """Failed transactions with their title."""
    kept = df.filter(_C("_line").contains("status='KO'") | _C("_line").contains('status="KO"'))
    kept = kept.withColumns({"_codes": error_codes("_line", "log"), "_title": _null_if_blank(F.regexp_extract("_line", r"titre='([^']+)'", 1))})
    return _event(kept, ts_text=ts_text("_line"), level=_L("ERROR"), service=_L("transaction"), error_code=F.coalesce(F.get("_codes", _L(0)), _L("TRANSACTION_KO")),
                  endpoint=_C("_title"), message=F.concat(_L("Transaction KO"), F.coalesce(F.concat(_L(": "), _C("_title")), _L(""))),
                  upstream_system=upstream_system("_line"), matched_error_codes=_C("_codes"))


PARSERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "api": _api, "http": _http, "database": _database, "generic": _generic, "app_error": _app_error, "performance": _performance, "transaction": _transaction,
}


def parse_lines(df: DataFrame, line: str = "line", strategy: str = "generic", service: str = "api") -> DataFrame:
    """Add the event columns of one line format and keep only the lines it keeps."""
    lines = df.withColumn("_line", F.trim(_C(line))).filter(F.length("_line") > 0)
    return PARSERS[strategy](lines, service)


def parse_by_strategy(df: DataFrame, line: str, strategy: str, service: str = "api") -> DataFrame:
    """Rows whose column ``strategy`` names their parser; each parser sees only its rows."""
    return reduce(DataFrame.unionByName, [parse_lines(df.filter(_C(strategy) == s), line, s, service) for s in PARSERS])


def filter_log_noise(df: DataFrame, level: str = "level", message: str = "message") -> DataFrame:
    """Error levels only, operational noise dropped."""
    return df.filter(_C(level).isin("ERROR", "WARN", "WARNING", "FATAL", "CRITICAL") & ~_C(message).rlike(fv.LOG_NOISE))
