"""Queries: web-access logs (S09, X01-X11) on the ``weblogs`` lines derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6, null_safe_join
from ..operators import weblog as wl
from ..session import ensure_checkpoint_dir
from ..sources.tables import SITE_HOST, WEBLOG_LINES_SQL, table, weblog_lines
from .catalog import query, with_ctes


def _g(i):
    return f"regexp_extract(line, '{wl.CLF_RE}', {i})"


def _q(s):
    return s.replace("'", "''")


def _nz(e):
    return f"nullif({e}, '')"


PARSED_SQL = WEBLOG_LINES_SQL + """,
parsed AS (
  SELECT event_id, """ + f"""{_nz(_g(1))} AS ip,
    strptime(substr({_g(2)}, 1, 20), '%d/%b/%Y:%H:%M:%S') AS ts,
    {_nz(_g(3))} AS method, {_nz(_g(4))} AS uri, {_nz(_g(5))} AS version,
    CAST({_nz(_g(6))} AS INTEGER) AS status, TRY_CAST({_nz(_g(7))} AS BIGINT) AS size,
    {_nz(_g(8))} AS referer, {_nz(_g(9))} AS user_agent
  FROM weblog_lines)"""


def parsed_weblogs(spark, sf):
    return wl.parse_clf(weblog_lines(spark, sf), keep=["event_id"])


@query("S09_parse_access_log", with_ctes("SELECT * FROM parsed", PARSED_SQL))
def s09(spark, sf):
    return parsed_weblogs(spark, sf)


_JSON_SQL = """js AS (
  SELECT event_id, to_json({'ip': '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(user_id % 251 AS VARCHAR),
    'time': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'method': 'GET', 'uri': '/' || event_type,
    'status': 200, 'size': CAST(round(value * 100) AS BIGINT)}) AS line FROM events)"""


@query("X01_parse_json_lines", with_ctes(
    "SELECT event_id, '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(user_id % 251 AS VARCHAR) AS ip,"
    " date_trunc('second', ts) AS ts, 'GET' AS method, '/' || event_type AS uri, NULL::VARCHAR AS version,"
    " 200 AS status, CAST(round(value * 100) AS BIGINT) AS size, NULL::VARCHAR AS referer,"
    " NULL::VARCHAR AS user_agent FROM events"))
def x01(spark, sf):
    ev = table(spark, sf, "events")
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"),
                     (F.col("user_id") % 251).cast("string"))
    lines = ev.select("event_id", F.to_json(F.struct(
        ip.alias("ip"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("uri"),
        F.lit(200).alias("status"), F.round(F.col("value") * 100).cast("bigint").alias("size")))
        .alias("line"))
    return wl.parse_json_lines(lines, keep=["event_id"])


@query("X01_parse_json_all_fields", with_ctes("SELECT * FROM parsed", PARSED_SQL))
def x01_all(spark, sf):
    """Every field of the log as JSON lines: the same rows as from the access-log lines."""
    rows = parsed_weblogs(spark, sf).withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("ts")
    lines = rows.select("event_id", F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"])).alias("line"))
    return wl.parse_json_lines(lines, keep=["event_id"])


@query("X01_parse_extended_log", with_ctes(
    "SELECT * REPLACE (CASE WHEN referer = '-' THEN NULL ELSE referer END AS referer) FROM parsed", PARSED_SQL))
def x01_elf(spark, sf):
    """The same rows from W3C extended log lines, whose fields a directive among the lines names."""
    r = parsed_weblogs(spark, sf)
    names = "date time c-ip cs-method sc-status cs-uri-stem cs-uri-query cs-version sc-bytes cs(Referer) cs(User-Agent)"
    lines = r.select("event_id", F.concat_ws(
        " ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "ip", "method", F.col("status").cast("string"),
        F.substring_index("uri", "?", 1), F.substring_index("uri", "?", -1), "version", F.col("size").cast("string"),
        F.coalesce("referer", F.lit("-")), F.translate("user_agent", " ", "+")).alias("line"))
    head = spark.createDataFrame([(None, "#Version: 1.0"), (None, f"#Fields: {names}")], "event_id long, line string")
    # the lines stand for files: written, so that parsing reads a column and not the expressions that made it
    ensure_checkpoint_dir(spark)
    return wl.parse_elf(head.unionByName(lines).checkpoint(eager=True), keep=["event_id"])


PAGES_SQL = r"""pg AS (
  SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"""


def _pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", "html", wl.url_path(F.col("url")).alias("path"),
                    wl.url_query(F.col("url")).alias("q"))


@query("X02_path_depth_url_length", with_ctes(
    "SELECT page_id, CAST(CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS INTEGER)"
    " AS path_depth, CAST(length(url) AS INTEGER) AS url_length FROM pg", PAGES_SQL))
def x02(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", wl.path_depth(F.col("path")).alias("path_depth"),
                    F.length("url").alias("url_length"))


def _count_sql(s, tok):
    t = tok.replace("'", "''")
    return f"CAST((length({s}) - length(replace({s}, '{t}', ''))) / {len(tok)} AS INTEGER)"


_SPECIAL_NAMES = {"'": "quote", '"': "dquote", ";": "semicolon", "--": "dashdash", "/*": "comment_open",
                  "*/": "comment_close", "%": "percent", "&": "amp", "=": "equals"}


@query("X03_special_char_counts", "SELECT page_id, " + ", ".join(
    f"{_count_sql('(url || html)', t)} AS n_{n}" for t, n in _SPECIAL_NAMES.items()) + " FROM pages")
def x03(spark, sf):
    p = table(spark, sf, "pages")
    s = F.concat(F.col("url"), F.col("html"))
    return p.select("page_id", *[c.alias(n) for n, c in wl.special_char_counts(s).items()])


@query("X04_extension_parameter_count", with_ctes(
    "SELECT page_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension,"
    " CAST(CASE WHEN q = '' THEN 0 ELSE len(string_split(q, '&')) END AS INTEGER) AS parameter_count FROM pg", PAGES_SQL))
def x04(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", wl.file_extension(F.col("path")).alias("extension"),
                    wl.parameter_count(F.col("q")).alias("parameter_count"))


def _rc(s, pat):
    return f"CAST(len(regexp_extract_all({s}, '{pat.replace(chr(39), chr(39) * 2)}')) AS INTEGER)"


@query("X05_injection_indicators",
       f"SELECT page_id, {_rc('(url || html)', wl.SQLI_RE)} AS sqli_hits,"
       f" {_rc('(url || html)', wl.XSS_RE)} AS xss_hits, {_rc('(url || html)', wl.CMD_RE)} AS cmd_hits,"
       f" round({_rc('(url || html)', '%[0-9A-Fa-f]{2}')} * 3.0 / length(url || html), 6) AS pct_encoded_share"
       " FROM pages")
def x05(spark, sf):
    p = table(spark, sf, "pages")
    s = F.concat(F.col("url"), F.col("html"))
    sc = wl.injection_scores(s)
    return p.select("page_id", sc["sqli_hits"].alias("sqli_hits"), sc["xss_hits"].alias("xss_hits"),
                    sc["cmd_hits"].alias("cmd_hits"), r6(sc["pct_encoded_share"]).alias("pct_encoded_share"))


@query("X06_request_features", with_ctes(
    "SELECT event_id, " + ", ".join(
        f"CAST(coalesce(method = '{m}', false) AS INTEGER) AS method_{m.lower()}" for m in wl.METHODS)
    + ", CAST(status / 100 AS INTEGER) AS status_class,"
    " CAST(regexp_matches(coalesce(user_agent, ''), '(?i)(bot|crawler|spider|slurp)') AS INTEGER) AS is_bot,"
    " CASE WHEN regexp_matches(coalesce(user_agent, ''), '(?i)bot|crawler|spider') THEN 'Bot'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Edg/') THEN 'Edge'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Chrome/') THEN 'Chrome'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Firefox/') THEN 'Firefox'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Safari/') THEN 'Safari' ELSE 'Other' END AS browser,"
    " CASE WHEN regexp_matches(coalesce(user_agent, ''), 'Windows') THEN 'Windows'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Mac OS X|Macintosh') THEN 'macOS'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Android') THEN 'Android'"
    " WHEN regexp_matches(coalesce(user_agent, ''), 'Linux') THEN 'Linux' ELSE 'Other' END AS os,"
    " CAST(length(coalesce(user_agent, '')) AS INTEGER) AS ua_length FROM parsed", PARSED_SQL))
def x06(spark, sf):
    f = wl.request_features(parsed_weblogs(spark, sf))
    return f.select("event_id", *[f"method_{m.lower()}" for m in wl.METHODS], "status_class",
                    "is_bot", "browser", "os", "ua_length")


@query("X07_success_error_rate", with_ctes(
    "SELECT p.event_id, p.ip, round(r.success_rate, 6) AS success_rate, round(r.error_rate, 6) AS error_rate"
    " FROM parsed p LEFT JOIN (SELECT ip, avg(CAST(status < 400 AS DOUBLE)) AS success_rate,"
    " avg(CAST(status >= 400 AS DOUBLE)) AS error_rate FROM parsed GROUP BY ip) r USING (ip)", PARSED_SQL))
def x07(spark, sf):
    p = parsed_weblogs(spark, sf)
    j = wl.join_back(p.select("event_id", "ip", "status"), wl.per_key_rates(p), "ip")
    return j.select("event_id", "ip", r6("success_rate").alias("success_rate"),
                    r6("error_rate").alias("error_rate"))


@query("X08_requests_per_minute", with_ctes(
    "SELECT 'ip' AS kind, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, ip AS k, count(*) AS n"
    " FROM parsed GROUP BY ALL UNION ALL SELECT 'uri', time_bucket(INTERVAL 1 MINUTE, ts), uri, count(*)"
    " FROM parsed GROUP BY ALL", PARSED_SQL))
def x08(spark, sf):
    p = parsed_weblogs(spark, sf)
    a = wl.requests_per_minute(p, "ip").select(F.lit("ip").alias("kind"), "window_start",
                                               F.col("ip").alias("k"), "n")
    b = wl.requests_per_minute(p, "uri").select(F.lit("uri").alias("kind"), "window_start",
                                                F.col("uri").alias("k"), "n")
    return a.unionByName(b)


@query("X09_referer_kind", with_ctes(
    "SELECT ip, kind, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY ip), 6) AS share"
    " FROM (SELECT ip, CASE WHEN referer IS NULL OR referer IN ('-', '') THEN 'missing'"
    f" WHEN lower(regexp_extract(referer, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) = '{SITE_HOST}'"
    " THEN 'self' ELSE 'external' END AS kind FROM parsed) GROUP BY ip, kind", PARSED_SQL))
def x09(spark, sf):
    p = parsed_weblogs(spark, sf).select("ip", wl.referer_kind(F.col("referer"), SITE_HOST).alias("kind"))
    counts = p.groupBy("ip", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("ip").agg(F.sum("n").alias("t"))
    return null_safe_join(counts, totals, ["ip"]).select("ip", "kind", "n", r6(F.col("n") / F.col("t")).alias("share"))


@query("X10_time_features", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,"
       " CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,"
       " CAST(hour(ts) >= 9 AND hour(ts) < 17 AS INTEGER) AS business_hours FROM events")
def x10(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", *[c.alias(n) for n, c in wl.time_features(F.col("ts")).items()])


@query("X11_per_ip_profile", with_ctes(
    "SELECT ip, count(DISTINCT uri) AS unique_uris, count(DISTINCT status) AS unique_statuses,"
    " count(*) AS requests, round(avg(CAST(status >= 400"
    f" OR regexp_matches(coalesce(uri, ''), '{_q(wl.SQLI_RE)}') OR regexp_matches(coalesce(uri, ''), '{_q(wl.XSS_RE)}')"
    f" OR regexp_matches(coalesce(uri, ''), '{_q(wl.CMD_RE)}') AS DOUBLE)), 6) AS suspicious_share"
    " FROM parsed GROUP BY ip", PARSED_SQL))
def x11(spark, sf):
    prof = wl.per_ip_profile(parsed_weblogs(spark, sf))
    return prof.select("ip", "unique_uris", "unique_statuses", "requests",
                       r6("suspicious_share").alias("suspicious_share"))
