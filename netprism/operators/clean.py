"""Cleaning (C01-C21).

Statistics that shape the plan (medians, modes, distinct ratios) are computed
in a bounded number of passes over all columns at once and returned as small
Python values; the data itself never leaves the executors.  ``fit_cleaning``
returns that state so the same cleaning can be applied to new data
(the reference re-derives it every run).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import LABEL_NAMES, detect_label, identifier_columns, numeric_columns
from ..functions.safe import bounded_broadcast, finite_or_null, is_missing, null_safe_join
from ..session import ensure_checkpoint_dir
from .quantiles import exact_median, exact_quantiles

UNKNOWN = "Unknown"

# Texts of the cleaning log that its readers look for.
LOG_COPIES = "{:,} duplicate records"
LOG_MISSING = "{:,} missing values ({:.2f}%)"
LOG_MEDIAN = "Filled with median ({:.2f})"
LOG_MODE = "Filled with mode ({})"


# ------------------------------------------------------------------ C01 / C13

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (map-side partial aggregation first)."""
    return df.dropDuplicates()


def flag_key_duplicates(df: DataFrame, key: Sequence[str], order_by: Sequence[str],
                        flag: str = "is_duplicate", hot: int = 100_000) -> DataFrame:
    """Per key keep the first row in ``order_by`` order, flag the others.

    Ties on ``order_by`` are broken by the remaining columns; identical rows are
    interchangeable; a null key is a key.  Rows are numbered within their key, so
    whole rows travel once.  Skew-safe: keys of more than ``hot`` rows, which a
    count of the keys finds first, are left out of that.  If there are any, rows are
    written with a number of their own; the firsts of these keys are a ``min`` over a
    struct, partially aggregated, and meet the rows by key as a small table.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key and c not in order_by]
    sort_cols = list(order_by) + rest
    ensure_checkpoint_dir(df.sparkSession)

    def numbered(rows):
        w = Window.partitionBy(*key).orderBy(*sort_cols)
        return rows.select(*df.columns, (F.row_number().over(w) > 1).alias(flag))

    large = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(*key)
             .checkpoint(eager=True))
    if large.isEmpty():
        return numbered(df)
    renamed = F.broadcast(large.withColumnsRenamed({c: f"__hot_{c}" for c in key}))
    among = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in key])
    rows = df.withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
    crowded = rows.join(renamed, among, "left_semi")
    firsts = crowded.groupBy(*key).agg(F.min(F.struct(*sort_cols, "__id")).alias("__f")).select(
        *key, F.col("__f.__id").alias("__first"))
    again = null_safe_join(crowded, F.broadcast(firsts), key).select(
        *df.columns, (F.col("__id") != F.col("__first")).alias(flag))
    return numbered(rows.join(renamed, among, "left_anti")).unionByName(again)


# ------------------------------------------------------------------ C02 / C03 / C10

def numeric_medians(df: DataFrame, cols: Sequence[str], exact: bool = True,
                    accuracy: int = 10_000) -> dict[str, float | None]:
    if not cols:
        return {}
    if exact:
        return exact_median(df, cols)
    row = df.agg(*[F.percentile_approx(F.col(c), 0.5, accuracy).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def modes(df: DataFrame, cols: Sequence[str], map_limit: int = 100_000) -> dict[str, object]:
    """Most frequent non-null value, smallest on ties (pandas ``mode()[0]``).

    ``F.mode`` keeps a value->count map per column in one buffer, so it is used
    only for columns whose estimated distinct count is below ``map_limit``
    (one HyperLogLog pass decides); other columns are counted with a
    distributed ``groupBy`` (``mode_by_groupby``)."""
    if not cols:
        return {}
    est = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    small = [c for i, c in enumerate(cols) if est[f"d{i}"] <= map_limit]
    out: dict[str, object] = {}
    if small:
        row = df.agg(*[F.mode(F.col(c), True).alias(f"m{i}") for i, c in enumerate(small)]).first()
        out.update({c: row[f"m{i}"] for i, c in enumerate(small)})
    for c in cols:
        if c not in out:
            out[c] = mode_by_groupby(df, c)
    return {c: out[c] for c in cols}


def mode_by_groupby(df: DataFrame, c: str):
    """Distributed mode: value counts (partial aggregation), then a top-1."""
    r = (df.where(F.col(c).isNotNull()).groupBy(c).count()
         .orderBy(F.desc("count"), F.asc(c)).limit(1).collect())
    return r[0][0] if r else None


def impute_median(df: DataFrame, cols: Sequence[str] | None = None,
                  exact: bool = True) -> tuple[DataFrame, dict]:
    """Fill nulls (and NaN) of numeric columns with the column median."""
    if cols is None:
        miss = _columns_with_missing(df)
        cols = [c for c in numeric_columns(df) if c in miss]
    med = numeric_medians(df, cols, exact=exact)
    return fill_values(df, med), med


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Fill nulls of categorical columns with the mode, ``Unknown`` if all null."""
    if cols is None:
        miss = _columns_with_missing(df)
        cols = [c for c in df.columns if c in miss and c not in numeric_columns(df)]
    m = modes(df, cols)
    m = {c: (UNKNOWN if v is None else v) for c, v in m.items()}
    return fill_values(df, m), m


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """``coalesce`` per column (NaN counts as missing for doubles)."""
    types = dict(df.dtypes)
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        col = F.col(c)
        if types[c] in ("double", "float"):
            col = F.when(~F.isnan(col), col)
        if types[c] == "boolean" and isinstance(v, str):
            v = v.lower() == "true"
        exprs[c] = F.coalesce(col, F.lit(v).cast(types[c])).alias(c)
    return df.withColumns(exprs) if exprs else df


def _columns_with_missing(df: DataFrame) -> set[str]:
    from .profile import missing_counts

    return {r["column"] for r in missing_counts(df).where("missing_count > 0").collect()}


def replace_infinite_then_median(df: DataFrame, cols: Sequence[str], exact: bool = True):
    """+-inf and NaN -> null, then median fill (median of the finite values)."""
    cleaned = df.withColumns({c: finite_or_null(c) for c in cols})
    return impute_median(cleaned, cols, exact=exact)


def replace_infinite(df: DataFrame, cols: Sequence[str], value: float = 1.0) -> DataFrame:
    """C11: +-inf / NaN / null -> constant."""
    return df.withColumns({c: F.coalesce(finite_or_null(c), F.lit(float(value))) for c in cols})


# ------------------------------------------------------------------ C04 / C05 / C06 / C07

def identifier_drop_list(df: DataFrame, match: str = "substring") -> list[str]:
    """Identifier-like columns by name (never the label)."""
    return [c for c in identifier_columns(df.columns, match) if c.lower() not in LABEL_NAMES]


def distinct_ratios(df: DataFrame, cols: Sequence[str], chunk: int = 4) -> DataFrame:
    """C05 helper: (column, distinct_ratio), exact, for the given columns.

    An exact distinct count of several columns copies every row once for each of them, so
    they are counted ``chunk`` at a time, one pass each."""
    spark = df.sparkSession
    n = df.count()
    rows = []
    for at in range(0, len(cols) if n else 0, chunk):
        own = cols[at:at + chunk]
        row = df.agg(*[F.count_distinct(c).alias(f"e{i}") for i, c in enumerate(own)]).first()
        rows += [(c, row[f"e{i}"] / n) for i, c in enumerate(own)]
    return spark.createDataFrame(rows, "column string, distinct_ratio double")


def high_cardinality_columns(df: DataFrame, threshold: float = 0.9,
                             label: str | None = None) -> list[str]:
    """Categorical columns with distinct/rows > threshold, never the label."""
    cats = [c for c in df.columns if df.schema[c].dataType == T.StringType()
            and c.lower() not in LABEL_NAMES and c != label]
    if not cats:
        return []
    ratios = distinct_ratios(df, cats).collect()
    return [r["column"] for r in ratios if r["distinct_ratio"] > threshold]


def high_cardinality_report(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """C05 as a Spark result: (column, high_cardinality) from one exact
    distinct-count aggregate (partial aggregation per task), long form."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("__n", f"stack({len(cols)}, {pairs}) as (column, n_distinct)")
    return long.select("column", (F.col("n_distinct") / F.col("__n") > threshold)
                       .alias("high_cardinality"))


def standardize_label(df: DataFrame, target: str = "Label") -> DataFrame:
    """C06 + C07: first label column renamed to ``Label``; string labels trimmed
    (all white space) and lower-cased."""
    lab = detect_label(df.columns)
    if lab is None:
        return df
    if lab != target:
        df = df.withColumnRenamed(lab, target)
    if df.schema[target].dataType == T.StringType():
        df = df.withColumn(target, normalize_label(F.col(target)))
    return df


def normalize_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


# ------------------------------------------------------------------ C08 / C09 (logs)

LOG_SCHEMA = "Column string, Issue string, Action string, Reason string"


@dataclass
class CleaningModel:
    """Fitted cleaning state: reusable on new data of the same layout."""

    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    dropped: list = field(default_factory=list)
    label_from: str | None = None
    log: list = field(default_factory=list)
    rows_before: int = 0
    rows_after: int = 0
    cols_before: int = 0
    cols_after: int = 0

    # the written, de-duplicated rows of the fit (not part of the saved state)
    fitted = None

    def transform(self, df: DataFrame, dedup: bool = True) -> DataFrame:
        if dedup:
            df = df.dropDuplicates()
        df = fill_values(df, {**self.medians, **self.modes})
        df = df.drop(*[c for c in self.dropped if c in df.columns])
        return standardize_label(df)

    def save(self, spark, path: str) -> None:
        """The fitted state as one JSON row in a folder that the cluster shares."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "state string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> CleaningModel:
        state = json.loads(spark.read.schema("state string").json(path).first()["state"])
        return cls(**{**state, "log": [tuple(r) for r in state["log"]]})

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)

    def summary_frame(self, spark) -> DataFrame:
        """C09."""
        return spark.createDataFrame(
            [(self.rows_before, self.rows_after, self.rows_before - self.rows_after,
              self.cols_before, self.cols_after, self.cols_before - self.cols_after)],
            "rows_before long, rows_after long, rows_removed long, columns_before int, "
            "columns_after int, columns_removed int")


def fit_cleaning(df: DataFrame, exact_median: bool = True,
                 identifier_match: str = "substring") -> CleaningModel:
    """C01-C09 as the reference runs them: dedup, median/mode fill, identifier and
    high-cardinality drop, label rename + normalise.  Returns the fitted state;
    ``model.transform(df)`` gives the cleaned frame."""
    m = CleaningModel(cols_before=len(df.columns))
    stats = df.agg(F.count(F.lit(1)).alias("n")).first()
    m.rows_before = stats["n"]
    # the statistics below read the de-duplicated rows about ten times: write
    # them once instead of repeating the all-column shuffle for every pass
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    dedup = m.fitted = df.dropDuplicates().checkpoint(eager=True)
    m.rows_after = dedup.count()
    if m.rows_before > m.rows_after:
        m.log.append(("All", LOG_COPIES.format(m.rows_before - m.rows_after),
                      "Kept one of each", "Copies would count twice in every statistic"))
    from .profile import missing_counts

    miss = {r["column"]: r["missing_count"]
            for r in missing_counts(dedup).where("missing_count > 0").collect()}
    num = set(numeric_columns(dedup))
    num_miss = [c for c in dedup.columns if c in miss and c in num]
    cat_miss = [c for c in dedup.columns if c in miss and c not in num]
    m.medians = numeric_medians(dedup, num_miss, exact=exact_median)
    m.modes = {c: (UNKNOWN if v is None else v) for c, v in modes(dedup, cat_miss).items()}
    for c in dedup.columns:
        if c in miss:
            pct = miss[c] * 100.0 / max(m.rows_after, 1)
            if c in m.medians:
                action = LOG_MEDIAN.format(m.medians[c]) if m.medians[c] is not None else "Left as is (all null)"
            else:
                action = LOG_MODE.format(m.modes[c])
            m.log.append((c, LOG_MISSING.format(miss[c], pct), action,
                          "A typical value leaves the column's centre in place"))
    filled = fill_values(dedup, {**m.medians, **m.modes})
    ids = identifier_drop_list(filled, identifier_match)
    high = high_cardinality_columns(filled)
    m.dropped = sorted(set(ids) | set(high), key=filled.columns.index)
    for c in m.dropped:
        m.log.append((c, "Names single rows (identifier or nearly unique)", "Dropped",
                      "A model would learn rows by heart"))
    lab = detect_label([c for c in filled.columns if c not in m.dropped])
    if lab and lab != "Label":
        m.label_from = lab
        m.log.append((lab, "Label under another name", 'Now called "Label"',
                      "One name for the label in all data sets"))
    m.cols_after = m.cols_before - len(m.dropped)
    return m


# ------------------------------------------------------------------ C12

def drop_rare_classes(df: DataFrame, label: str, min_count: int = 10,
                      broadcast_limit: int = 1_000_000) -> DataFrame:
    """Rows of classes with fewer than ``min_count`` rows removed.

    The null label is a class like any other.
    The class table (one row per kept class) is joined with a left-semi join.
    It is broadcast only below ``broadcast_limit`` classes (checked with a
    count of the small aggregate); beyond that the join is left to the
    planner (sort-merge, AQE skew handling).
    """
    keep = df.groupBy(label).count().where(F.col("count") >= min_count).select(label)
    return null_safe_join(df, bounded_broadcast(keep, broadcast_limit), [label], "left_semi")


# ------------------------------------------------------------------ C14 - C17

def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C14."""
    return df.fillna(0, subset=list(cols))


def forward_fill(df: DataFrame, cols: Sequence[str], key: str, order_by: Sequence[str],
                 skew_safe: bool = True, block_rows: int | None = None) -> DataFrame:
    """Last non-null value so far within ``key`` in ``order_by`` order.

    ``skew_safe`` (default) runs the window per (key, block of rows) with a
    carry-in from earlier blocks, so a key with a third of all rows is not one
    task; ``skew_safe=False`` is the plain per-key window."""
    if skew_safe:
        from .windows import DEFAULT_BLOCK_ROWS, forward_fill_blocked

        return forward_fill_blocked(df, cols, key, order_by, block_rows or DEFAULT_BLOCK_ROWS)
    w = (Window.partitionBy(key).orderBy(*order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})


def row_missing_share(cols: Sequence[str], floats: Sequence[str] = ()) -> Column:
    """Share of ``cols`` that are null, or NaN in one of ``floats``."""
    flags = [F.when(is_missing(c) if c in floats else F.col(c).isNull(), 1).otherwise(0) for c in cols]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total / F.lit(float(len(cols)))


def drop_sparse_rows(df: DataFrame, drop_above: float = 0.5, flag_above: float = 0.3,
                     cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with more than ``drop_above`` missing removed, rows with more than
    ``flag_above`` flagged (``sparse_flag``)."""
    cols = list(cols or df.columns)
    share = row_missing_share(cols, [c for c, t in df.dtypes if t in ("double", "float")])
    return (df.withColumn("missing_share", share)
            .where(F.col("missing_share") <= drop_above)
            .withColumn("sparse_flag", (F.col("missing_share") > flag_above).cast("int")))


def winsorize(df: DataFrame, cols: Sequence[str], upper: float = 0.99,
              lower: float | None = None) -> tuple[DataFrame, dict]:
    """C17: cap at the exact ``upper`` quantile (and optionally floor at ``lower``)."""
    qs = [upper] + ([lower] if lower is not None else [])
    cut = exact_quantiles(df, {c: qs for c in cols})
    exprs = {}
    for c in cols:
        e = F.least(F.col(c), F.lit(cut[c][0]))
        if lower is not None:
            e = F.greatest(e, F.lit(cut[c][1]))
        exprs[c] = F.when(F.col(c).isNotNull(), e)
    return df.withColumns(exprs), cut


# ------------------------------------------------------------------ C18 - C21 (web / files)

IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
CONTROL_CHARS = r"[\x00-\x1f\x7f]"


def web_record_valid(ip="ip", uri="uri", status="status", size="size") -> Column:
    return (F.coalesce(F.col(ip).rlike(IPV4), F.lit(False))
            & ~F.coalesce(F.col(uri).rlike(CONTROL_CHARS), F.lit(True))
            & F.coalesce(F.col(status).between(100, 599), F.lit(False))
            & F.coalesce(F.col(size) >= 0, F.lit(True)))


def split_valid_web_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by IP syntax, control characters in the URI, status
    range and size sign."""
    ok = web_record_valid()
    return df.where(ok), df.where(~ok)


def semantic_defaults(df: DataFrame, defaults: Mapping[str, object] | None = None,
                      direct_referer: str = "referer") -> DataFrame:
    """User agent -> 'Unknown', missing referer ('-' or null) -> 'Direct',
    other strings -> ''."""
    exprs = {}
    if direct_referer in df.columns:
        r = F.col(direct_referer)
        exprs[direct_referer] = F.when(r.isNull() | (r == "-") | (r == ""), "Direct").otherwise(r)
    for c, v in (defaults or {}).items():
        exprs[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(exprs)


# Leading bytes of executable, document and archive files.
MAGIC_NUMBERS = {b"MZ": "pe", b"\x7fELF": "elf", b"%PDF": "pdf", b"PK": "zip"}


def file_kind(content: str = "content") -> Column:
    """Kind of a file by its leading bytes, null if none of ``MAGIC_NUMBERS`` fits."""
    kind = F.lit(None).cast("string")
    for m, name in MAGIC_NUMBERS.items():
        kind = F.when(F.substring(F.col(content), 1, len(m)) == F.lit(bytearray(m)), name).otherwise(kind)
    return kind


def file_filter(df: DataFrame, length: str = "length", content: str = "content",
                min_bytes: int = 1024, max_bytes: int = 100 * 1024 * 1024,
                magic: Sequence[bytes] | None = None) -> DataFrame:
    """C20: size window (the ``length`` predicate of ``binaryFile`` is pushed into
    the file listing) and optional magic-byte prefixes."""
    out = df.where(F.col(length).between(min_bytes, max_bytes))
    if magic:
        cond = F.lit(False)
        for m in magic:
            cond = cond | (F.substring(F.col(content), 1, len(m)) == F.lit(bytearray(m)))
        out = out.where(cond)
    return out


# PII patterns masked by C21.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
IP_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def mask_pii(c: Column) -> Column:
    """E-mail addresses, IPv4 addresses and phone numbers replaced by tags."""
    c = F.regexp_replace(c, EMAIL_RE, "<EMAIL>")
    c = F.regexp_replace(c, IP_RE, "<IP>")
    return F.regexp_replace(c, PHONE_RE, "<PHONE>")
