"""Network-flow features.

Each derived column is added only when its input columns exist, as in the
reference; the plan is built on the driver from ``df.columns`` and is a single
projection (no shuffle) except F16/F17 which group by a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import find_column
from ..functions.safe import bounded_broadcast, finite_or_null, pandas_div

# Fixed values (reference behaviour): TCP flag weights, port ranges, epsilon.
FLAG_WEIGHTS = (("SYN", 1), ("ACK", 2), ("FIN", 4), ("RST", 8), ("PSH", 16), ("URG", 32))
WELL_KNOWN_PORT_LIMIT = 1024
EPHEMERAL_LOW, EPHEMERAL_HIGH = 49152, 65535
CV_EPS = 1e-6

# Feature log rows (F13): name -> (type, formula, usefulness).  The formulas are fixed values.
FEATURE_DOC = {
    "Packet_Ratio": ("Statistical", "Total Fwd Packets / (Total Backward Packets + 1)",
                     "Communication asymmetry"),
    "Byte_Ratio": ("Statistical", "Total Fwd Bytes / (Total Bwd Bytes + 1)",
                   "Direction of data transfer"),
    "Asymmetry_Score": ("Behavioral", "|Fwd Packets - Bwd Packets| / (Total Packets + 1)",
                        "Scanning or flooding asymmetry"),
    "Burstiness": ("Temporal", "Flow IAT Std / (Flow IAT Mean + 1e-6)", "Bursty traffic"),
    "Flow_Rate": ("Temporal", "Total Packets / (Flow Duration + 1)", "Flooding"),
    "Packet_Size_CV": ("Statistical", "Packet Length Std / (Packet Length Mean + 1e-6)",
                       "Packet size variation"),
    "Flag_Combination_Score": ("Behavioral", "Weighted sum of TCP flags",
                               "Connection state"),
    "Well_Known_Port": ("Behavioral", "1 if port < 1024, else 0", "Targeted services"),
    "Ephemeral_Port": ("Behavioral", "1 if port in 49152-65535, else 0", "Client side ports"),
    "Packet_Ratio_UNSW": ("Statistical", "spkts / (dpkts + 1)", "Packet ratio"),
    "Byte_Ratio_UNSW": ("Statistical", "sbytes / (dbytes + 1)", "Byte ratio"),
    "Byte_Ratio_NSL": ("Statistical", "src_bytes / (dst_bytes + 1)", "Byte ratio"),
    "Service_Count_Ratio": ("Behavioral", "count / (srv_count + 1)", "Service spread"),
}


def _ratio(num: str, den: str, plus: float) -> Column:
    # pandas semantics: division by zero (den = -plus) gives +-inf / NaN.
    return pandas_div(F.col(num), F.col(den).cast("double") + F.lit(plus))


def flag_columns(columns: Sequence[str]) -> dict[str, str]:
    """First column per TCP flag whose name contains the flag (case-insensitive token)."""
    out = {}
    for flag, _ in FLAG_WEIGHTS:
        for c in columns:
            if flag in c.upper().replace("_", " ").split() or flag in c:
                out[flag] = c
                break
    return out


def port_column(columns: Sequence[str]) -> str | None:
    for c in columns:
        low = c.lower()
        if "port" in low and ("destination" in low or "dport" in low):
            return c
    for c in columns:
        low = c.lower()
        if "dport" in low or low == "dst_port":
            return c
    return None


def flow_feature_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Name -> expression for every feature whose inputs are present."""
    cols = list(columns)
    fwd = find_column(cols, "Total Fwd Packets")
    bwd = find_column(cols, "Total Backward Packets")
    fwd_b = find_column(cols, "Total Length of Fwd Packets")
    bwd_b = find_column(cols, "Total Length of Bwd Packets")
    iat_m = find_column(cols, "Flow IAT Mean")
    iat_s = find_column(cols, "Flow IAT Std")
    dur = find_column(cols, "Flow Duration")
    len_m = find_column(cols, "Packet Length Mean")
    len_s = find_column(cols, "Packet Length Std")
    out: dict[str, Column] = {}
    if fwd and bwd:
        out["Packet_Ratio"] = _ratio(fwd, bwd, 1)
    if fwd_b and bwd_b:
        out["Byte_Ratio"] = _ratio(fwd_b, bwd_b, 1)
    if fwd and bwd:
        tot = F.col(fwd) + F.col(bwd)
        out["Asymmetry_Score"] = pandas_div(F.abs(F.col(fwd) - F.col(bwd)), tot + 1)
    if iat_m and iat_s:
        out["Burstiness"] = _ratio(iat_s, iat_m, CV_EPS)
    if dur and fwd and bwd:
        out["Flow_Rate"] = pandas_div(F.col(fwd) + F.col(bwd), F.col(dur).cast("double") + 1)
    if len_m and len_s:
        out["Packet_Size_CV"] = _ratio(len_s, len_m, CV_EPS)
    flags = flag_columns(cols)
    if len(flags) >= 3:
        score = F.lit(0)
        for flag, w in FLAG_WEIGHTS:
            if flag in flags:
                score = score + F.coalesce(F.col(flags[flag]), F.lit(0)) * w
        out["Flag_Combination_Score"] = score
    port = port_column(cols)
    if port:
        p = F.col(port)
        out["Well_Known_Port"] = F.coalesce(p < WELL_KNOWN_PORT_LIMIT, F.lit(False)).cast("int")
        out["Ephemeral_Port"] = F.coalesce(p.between(EPHEMERAL_LOW, EPHEMERAL_HIGH),
                                           F.lit(False)).cast("int")
    for a, b, name in (("spkts", "dpkts", "Packet_Ratio_UNSW"),
                       ("sbytes", "dbytes", "Byte_Ratio_UNSW"),
                       ("src_bytes", "dst_bytes", "Byte_Ratio_NSL"),
                       ("count", "srv_count", "Service_Count_Ratio")):
        ca, cb = find_column(cols, a), find_column(cols, b)
        if ca and cb:
            out[name] = _ratio(ca, cb, 1)
    return out


def engineer_flow_features(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """One projection that appends every applicable feature."""
    exprs = flow_feature_columns(df.columns)
    if only is not None:
        exprs = {k: v for k, v in exprs.items() if k in only}
    return df.withColumns(exprs) if exprs else df


def feature_log(df: DataFrame) -> DataFrame:
    """Feature, Type, Formula and Usefulness of the features that apply to ``df``, with what its rows make of
    them: n_rows, n_values (finite ones), lowest and highest value, from one pass."""
    exprs = flow_feature_columns(df.columns)
    if not exprs:
        return df.sparkSession.createDataFrame([], "Feature string, Type string, Formula string, Usefulness string, "
                                                   "n_rows long, n_values long, lowest double, highest double")
    aggs, parts = [F.count(F.lit(1)).alias("n_rows")], []
    for i, (name, e) in enumerate(exprs.items()):
        value = finite_or_null(e.cast("double"))
        aggs += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"a{i}"), F.max(value).alias(f"b{i}")]
        parts.append(", ".join([*(repr(x) for x in (name, *FEATURE_DOC[name])), f"n{i}", f"a{i}", f"b{i}"]))
    return df.agg(*aggs).selectExpr(f"stack({len(parts)}, {', '.join(parts)}) as "
                                    "(Feature, Type, Formula, Usefulness, n_values, lowest, highest)", "n_rows")


# ----------------------------------------------------------------- documents-only features

def half_open_flag(syn: str, ack: str) -> Column:
    """SYN seen without ACK."""
    return ((F.coalesce(F.col(syn), F.lit(0)) > 0)
            & (F.coalesce(F.col(ack), F.lit(0)) == 0)).cast("int")


def window_ratio(fwd_win: str, bwd_win: str) -> Column:
    """TCP window ratio fwd/(bwd+1)."""
    return _ratio(fwd_win, bwd_win, 1)


def interarrival_moments(df: DataFrame, key: str, ts: str, order: Sequence[str] = ()) -> DataFrame:
    """Per key, the gaps between consecutive events (seconds) and their
    count, mean, population std, min, max and population skewness.

    One shuffle on ``key`` (the window); the aggregate reuses that partitioning.
    A key holding a third of all rows stays one window partition that is
    streamed in order, not held in memory.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts), *[F.col(c) for c in order])
    micros = epoch_micros(F.col(ts))
    gaps = df.select(key, (micros - F.lag(micros).over(w)).alias("_gap_us"))
    g = F.col("_gap_us") / 1e6
    return (gaps.where(F.col("_gap_us").isNotNull())
            .groupBy(key)
            .agg(F.count("*").alias("n_gaps"), F.avg(g).alias("gap_mean"),
                 F.stddev_pop(g).alias("gap_std"), F.min(g).alias("gap_min"),
                 F.max(g).alias("gap_max"), F.skewness(g).alias("gap_skew")))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (timestamp_ntz) value.

    Does not depend on the session time zone.
    """
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"),
                            ts.cast("timestamp_ntz"))


def group_entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """Shannon entropy (bits) of ``value`` within each ``key``.

    Two aggregates, both with map-side partial aggregation: counts per
    (key, value), then per key ``log2(N) - sum(c*log2(c))/N``.  No window and no
    join, so a key with a third of all rows is pre-aggregated before the shuffle.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    c = F.col("_c").cast("double")
    per_key = counts.groupBy(key).agg(F.sum("_c").alias("n_flows"),
                                      F.sum(c * F.log2(c)).alias("_clogc"))
    n = F.col("n_flows").cast("double")
    return per_key.select(key, "n_flows", (F.log2(n) - F.col("_clogc") / n).alias("entropy"))


def map_code(c: Column, mapping: dict) -> Column:
    """value -> code from a fixed literal map (null when absent)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), c)


def one_hot(df: DataFrame, c: str, values: Sequence[str] | None = None, prefix: str | None = None,
            null_column: bool = False, max_values: int = 1000) -> DataFrame:
    """0/1 column per value.  The value list is given, or found with a
    bounded distinct (fails above ``max_values`` instead of widening without end)."""
    if values is None:
        vals = (df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_values + 1)
                .collect())
        if len(vals) > max_values:
            raise ValueError(f"{c} has more than {max_values} values; pass them explicitly")
        values = sorted(r[0] for r in vals)
    prefix = f"{c}_" if prefix is None else prefix
    cols = {f"{prefix}{v}": F.coalesce((F.col(c) == F.lit(v)), F.lit(False)).cast("int")
            for v in values}
    if null_column:
        cols[f"{prefix}null"] = F.col(c).isNull().cast("int")
    return df.withColumns(cols)


def port_normalised(c: str) -> Column:
    """port / 65535."""
    return F.col(c) / F.lit(65535.0)


def merge_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    """union of data sets with different layouts; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# The documented multi-class codes of each module (code = place in the list; code 0 is no attack).
LABEL_CODES = {
    "network": ("Normal", "DDoS", "PortScan", "WebAttack", "Infiltration", "Probe", "R2L", "U2R", "Other"),
    "web": ("Normal", "SQL Injection", "XSS", "Path Traversal", "Command Injection", "Brute Force", "CSRF", "Other"),
    "malware": ("Benign", "Trojan", "Worm", "Ransomware", "Rootkit", "Backdoor", "Spyware", "Other"),
}


def label_table(spark, module: str) -> DataFrame:
    """(raw, category, multi_code, binary_code) of a module of ``LABEL_CODES``; ``raw`` is the category
    in lower case without spaces (see ``label_key``)."""
    rows = [(c.lower().replace(" ", ""), c, i, int(i > 0)) for i, c in enumerate(LABEL_CODES[module])]
    return spark.createDataFrame(rows, "raw string, category string, multi_code int, binary_code int")


def label_key(label: Column) -> Column:
    """A label as ``label_table`` spells it: 'SQL_Injection', ' sql injection' and 'Sql-Injection' are one."""
    return F.regexp_replace(F.lower(label), r"[\s_-]+", "")


def map_labels(df: DataFrame, label: str, mapping: DataFrame, raw: str = "raw",
               unknown_category: str = "unknown", unknown_code: int = -1) -> DataFrame:
    """raw label -> (category, multi-class code, binary code).

    ``mapping`` is a fixed label table (tens of rows, a literal): broadcast is
    safe.  Unmapped labels get ``unknown_category`` / ``unknown_code`` / 1 (attack).
    """
    j = df.join(bounded_broadcast(mapping), df[label] == mapping[raw], "left").drop(raw)
    return j.withColumns({
        "category": F.coalesce(F.col("category"), F.lit(unknown_category)),
        "multi_code": F.coalesce(F.col("multi_code"), F.lit(unknown_code)),
        "binary_code": F.coalesce(F.col("binary_code"), F.lit(1)),
    })
