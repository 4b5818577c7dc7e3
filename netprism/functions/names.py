"""Schema rules that run on the driver: they look at column names only.

The reference dispatches every feature on the presence of named columns
(for example 'Total Fwd Packets').  Data sets spell the same field as
``Total Fwd Packets``, ``total_fwd_packets`` or ``TotalFwdPackets``; names are
compared after :func:`canonical`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values (reference behaviour): label column names, identifier patterns.
LABEL_NAMES = ("label", "class", "attack", "target")
IDENTIFIER_PATTERNS = ("id", "index", "timestamp", "time", "date")
NORMAL_LABELS = ("normal",)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def canonical(name: str) -> str:
    """'Total Fwd Packets' -> 'total_fwd_packets'."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def find_column(columns: Iterable[str], *candidates: str) -> str | None:
    """First column whose canonical name equals one of the candidates."""
    wanted = [canonical(c) for c in candidates]
    cols = list(columns)
    for w in wanted:
        for c in cols:
            if canonical(c) == w:
                return c
    return None


def find_by_keywords(columns: Iterable[str], *keywords: str) -> str | None:
    """First column whose lower-cased name contains every keyword."""
    kws = [k.lower() for k in keywords]
    for c in columns:
        low = c.lower()
        if all(k in low for k in kws):
            return c
    return None


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String and boolean columns: the reference's ``object`` columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))
            and f.name not in exclude]


def detect_label(columns: Iterable[str], mode: str = "exact") -> str | None:
    """P07.  ``exact``: lower-cased name in LABEL_NAMES (first column wins).
    ``substring``: name contains 'label' or 'class' (anomaly module rule).
    ``label``: lower-cased name equals 'label' (classifier rule).
    """
    cols = list(columns)
    if mode == "exact":
        hits = [c for c in cols if c.lower() in LABEL_NAMES]
    elif mode == "substring":
        hits = [c for c in cols if "label" in c.lower() or "class" in c.lower()]
    elif mode == "label":
        hits = [c for c in cols if c.lower() == "label"]
    else:
        raise ValueError(mode)
    return hits[0] if hits else None


def identifier_columns(columns: Iterable[str], match: str = "substring") -> list[str]:
    """C04.  ``substring`` reproduces the reference (``id`` also hits ``Idle``),
    ``token`` only matches whole name tokens."""
    out = []
    for c in columns:
        low = c.lower()
        if match == "substring":
            hit = any(p in low for p in IDENTIFIER_PATTERNS)
        elif match == "token":
            toks = set(canonical(c).split("_"))
            hit = bool(toks & set(IDENTIFIER_PATTERNS))
        else:
            raise ValueError(match)
        if hit:
            out.append(c)
    return out


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()
