"""Web-access-log parsing and features.

All scalar work is regular-expression and string functions inside the JVM
(whole-stage codegen); per-IP statistics are one aggregate plus an equi-join
back (AQE splits a hot IP's partition; the aggregated side has one row per IP).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (log formats, keyword lists).
CLF_RE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?$'
CLF_FIELDS = ("ip", "time", "method", "uri", "version", "status", "size", "referer", "user_agent")
ELF_FIELDS = ("date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "cs-version", "sc-status", "sc-bytes",
              "cs(Referer)", "cs(User-Agent)")
SPECIAL_TOKENS = ("'", '"', ";", "--", "/*", "*/", "%", "&", "=")
SQLI_RE = r"(?i)(union\s+select|select\s.+\sfrom|insert\s+into|drop\s+table|\bor\s+1=1|'--|;--)"
XSS_RE = r"(?i)(<script|javascript:|onerror\s*=|onload\s*=|<iframe|alert\()"
CMD_RE = r"(;\s*(ls|cat|rm|wget|curl|bash|sh)\b|&&|\|\||`|\$\()"
BOT_RE = r"(?i)(bot|crawler|spider|slurp)"
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD")
JSON_LOG_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()), T.StructField("time", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("referer", T.StringType()),
    T.StructField("user_agent", T.StringType())])


def clf_time_to_utc(s: Column) -> Column:
    """'10/Oct/2000:13:55:36 -0700' -> timestamp_ntz in UTC (no session time zone)."""
    local = F.to_timestamp_ntz(F.substring(s, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    off = F.regexp_extract(s, r"([+-])(\d{2})(\d{2})$", 0)
    sign = F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(off, 2, 2).cast("int") * 60 + F.substring(off, 4, 2).cast("int"))
    return F.timestamp_add("MINUTE", -F.coalesce(minutes, F.lit(0)), local)


def parse_clf(lines: DataFrame, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Common and combined log format -> one typed schema.

    Lines that do not match keep nulls in every field (filter with C18)."""
    # the groups are columns of their own: what reads one twice does not match the line again
    found = lines.select(*keep, *[F.regexp_extract(F.col(line), CLF_RE, i + 1).alias(f"__{name}")
                                  for i, name in enumerate(CLF_FIELDS)])

    def nz(name):  # empty group -> null
        c = F.col(f"__{name}")
        return F.when(c != "", c)

    return found.select(
        *[F.col(f"`{c}`") for c in found.columns[:len(keep)]],
        nz("ip").alias("ip"),
        clf_time_to_utc(nz("time")).alias("ts"),
        nz("method").alias("method"), nz("uri").alias("uri"),
        nz("version").alias("version"),
        nz("status").cast("int").alias("status"),
        nz("size").try_cast("bigint").alias("size"),
        nz("referer").alias("referer"), nz("user_agent").alias("user_agent"))


def parse_json_lines(lines: DataFrame, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """JSON log lines -> the same schema (time as ISO-8601 with offset)."""
    j = F.from_json(F.col(line), JSON_LOG_SCHEMA)
    return lines.select(*keep, j.alias("j")).select(
        *keep, "j.ip",
        F.to_timestamp_ntz(F.col("j.time")).alias("ts"),
        "j.method", "j.uri", "j.version", "j.status", "j.size", "j.referer", "j.user_agent")


def elf_fields(lines: DataFrame, line: str = "line") -> list[str] | None:
    """The names of the first ``#Fields:`` directive (files of one table share it), or None."""
    row = lines.where(F.startswith(F.col(line), F.lit("#Fields:"))).select(line).first()
    return row[0][len("#Fields:"):].split() if row else None


def parse_elf(lines: DataFrame, fields: Sequence[str] | None = None, line: str = "line",
              keep: Sequence[str] = ()) -> DataFrame:
    """W3C extended log lines -> the schema of ``parse_clf``; dates and times are UTC by definition.

    ``fields`` are the directive's names (default: the first one among the lines).  Directives
    are no rows; a ``-``, an absent field and a value of the wrong type are null.  A ``+`` in the
    user agent or referer stands for a space."""
    names = list(fields or elf_fields(lines, line) or ELF_FIELDS)
    parts = F.split(F.trim(F.col(line)), r"\s+")

    def value(name):
        if name not in names:
            return F.lit(None).cast("string")
        got = F.get(parts, names.index(name))
        return F.when(got != "-", got)

    stamp = F.concat_ws(" ", value("date"), value("time"))
    stem, query = value("cs-uri-stem"), value("cs-uri-query")
    uri = F.coalesce(value("cs-uri"), F.when(query.isNull(), stem).otherwise(F.concat_ws("?", stem, query)))
    rows = lines.where(~F.startswith(F.col(line), F.lit("#")) | F.col(line).isNull())
    return rows.select(
        *keep, value("c-ip").alias("ip"),
        F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), stamp).try_cast("timestamp_ntz").alias("ts"),
        value("cs-method").alias("method"), uri.alias("uri"), value("cs-version").alias("version"),
        value("sc-status").try_cast("int").alias("status"), value("sc-bytes").try_cast("bigint").alias("size"),
        F.translate(value("cs(Referer)"), "+", " ").alias("referer"),
        F.translate(value("cs(User-Agent)"), "+", " ").alias("user_agent"))


def read_logs(spark, path: str, fmt: str = "clf") -> DataFrame:
    """Text files of log lines (one line per row; files are split by Spark): clf, json or elf."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return {"json": parse_json_lines, "elf": parse_elf}.get(fmt, parse_clf)(lines)


# ----------------------------------------------------------------- URL features

def url_path(url: Column) -> Column:
    """Path of an absolute url, or of a URI as logs have it (``/a/b.php?x=1``)."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def path_depth(path: Column) -> Column:
    """Number of '/' separated segments after the leading slash."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")) - 1)


def count_token(s: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / len(token)).cast("int")


def special_char_counts(s: Column) -> dict[str, Column]:
    names = {"'": "quote", '"': "dquote", ";": "semicolon", "--": "dashdash", "/*": "comment_open",
             "*/": "comment_close", "%": "percent", "&": "amp", "=": "equals"}
    return {f"n_{names[t]}": count_token(s, t) for t in SPECIAL_TOKENS}


def file_extension(path: Column) -> Column:
    """Lower-case extension of the last path segment ('' when none)."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parameter_count(query: Column) -> Column:
    """X04."""
    return F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))


def injection_scores(s: Column) -> dict[str, Column]:
    """SQL / XSS / command pattern hits and URL-encoding share."""
    return {
        "sqli_hits": F.regexp_count(s, F.lit(SQLI_RE)),
        "xss_hits": F.regexp_count(s, F.lit(XSS_RE)),
        "cmd_hits": F.regexp_count(s, F.lit(CMD_RE)),
        "pct_encoded_share": F.try_divide(F.regexp_count(s, F.lit(r"%[0-9A-Fa-f]{2}")) * 3.0,
                                          F.length(s)),
    }


def browser_family(ua: Column) -> Column:
    return (F.when(ua.rlike("(?i)bot|crawler|spider"), "Bot")
            .when(ua.rlike("Edg/"), "Edge").when(ua.rlike("Chrome/"), "Chrome")
            .when(ua.rlike("Firefox/"), "Firefox").when(ua.rlike("Safari/"), "Safari")
            .otherwise("Other"))


def os_family(ua: Column) -> Column:
    return (F.when(ua.rlike("Windows"), "Windows").when(ua.rlike("Mac OS X|Macintosh"), "macOS")
            .when(ua.rlike("Android"), "Android").when(ua.rlike("Linux"), "Linux")
            .otherwise("Other"))


def request_features(df: DataFrame) -> DataFrame:
    """Method one-hot, status class, bot flag, browser / OS family, UA length."""
    ua = F.coalesce(F.col("user_agent"), F.lit(""))
    cols = {f"method_{m.lower()}": F.coalesce(F.col("method") == m, F.lit(False)).cast("int")
            for m in METHODS}
    cols.update({
        "status_class": (F.col("status") / 100).cast("int"),
        "is_bot": ua.rlike(BOT_RE).cast("int"),
        "browser": browser_family(ua), "os": os_family(ua),
        "ua_length": F.length(ua),
    })
    return df.withColumns(cols)


def per_key_rates(df: DataFrame, key: str = "ip", status: str = "status") -> DataFrame:
    """Success (status < 400) and error (>= 400) rate per key."""
    return df.groupBy(key).agg(
        F.avg((F.col(status) < 400).cast("double")).alias("success_rate"),
        F.avg((F.col(status) >= 400).cast("double")).alias("error_rate"))


def join_back(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Attach per-key statistics to every row: equi-join on the key.  The stats
    side has one row per key; AQE's skew-join handling splits a hot key's rows."""
    return df.join(stats, key, "left")


def requests_per_minute(df: DataFrame, key: str, ts: str = "ts", duration: str = "1 minute") -> DataFrame:
    """X08.  Rows without a time are in no window.

    ``window`` drops these with a filter on the time, which Spark would move below every step that
    made it and so make the time, and what it is made from, anew in every part of the filter; it
    does not move a filter below the explode that made the filtered column."""
    row = F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))
    rows = df.select(F.explode(F.array(row)).alias("r")).select("r.t", F.col("r.k").alias(key))
    return (rows.groupBy(F.window("t", duration).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), key, "n"))


def referer_host(r: Column) -> Column:
    return F.lower(F.regexp_extract(r, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def referer_kind(r: Column, site_host: str) -> Column:
    """Missing / self / external."""
    return (F.when(r.isNull() | (r == "-") | (r == ""), "missing")
            .when(referer_host(r) == site_host.lower(), "self").otherwise("external"))


def time_features(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday = 0), weekend, business hours [9, 17)."""
    dow = F.weekday(ts)
    h = F.hour(ts)
    return {"hour": h, "day_of_week": dow, "is_weekend": (dow >= 5).cast("int"),
            "business_hours": ((h >= 9) & (h < 17)).cast("int")}


def per_ip_profile(df: DataFrame, key: str = "ip") -> DataFrame:
    """X11: unique URIs, unique statuses, request count and suspicious share
    (error status or an injection pattern in the URI)."""
    uri = F.coalesce(F.col("uri"), F.lit(""))
    suspicious = ((F.col("status") >= 400) | uri.rlike(SQLI_RE) | uri.rlike(XSS_RE)
                  | uri.rlike(CMD_RE))
    return df.groupBy(key).agg(
        F.count_distinct("uri").alias("unique_uris"),
        F.count_distinct("status").alias("unique_statuses"),
        F.count(F.lit(1)).alias("requests"),
        F.avg(suspicious.cast("double")).alias("suspicious_share"))
