"""Scalar column functions with numpy/pandas semantics spelled out.

Spark differs from numpy on edge values: ``ln(0)`` and ``x / 0`` are NULL
or errors in Spark (ANSI mode), while numpy gives -inf / inf. The helpers
below state the numpy result explicitly; NaN becomes NULL because the
reference treats NaN as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL (pandas treats NaN as missing, Spark as a value)."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_ln(c) -> Column:
    """Natural log as numpy: 0 -> -inf, negative -> missing (NULL)."""
    c = _c(c)
    return (F.when(c > 0, F.ln(c))
             .when(c == 0, F.lit(-INF))
             .otherwise(F.lit(None).cast("double")))


def safe_div(a, b) -> Column:
    """a / b as numpy: x/0 -> +-inf, 0/0 -> missing (NULL)."""
    a, b = _c(a), _c(b)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
             .when(b != 0, a / b)
             .when(a > 0, F.lit(INF))
             .when(a < 0, F.lit(-INF))
             .otherwise(F.lit(None).cast("double")))


def clip(c, lo, hi) -> Column:
    """Two-sided limit; a NULL value stays NULL (greatest/least skip nulls)."""
    c = _c(c)
    return F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, _c(lo)), _c(hi)))


def hash_bucket(seed: int, *keys, modulo: int = 10000) -> Column:
    """Deterministic bucket in [0, modulo) from md5 of ``seed|key1|key2...``.

    Same number in DuckDB: ('0x' || substr(md5(...), 1, 8))::bigint % modulo.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(modulo))


def round_half_even(c, places: int = 3) -> Column:
    """Python ``round`` (banker's rounding)."""
    return F.bround(_c(c), places)


def residual(y, p) -> Column:
    return _c(y) - _c(p)


def error(y, p) -> Column:
    return _c(p) - _c(y)


def peptide_position(sequence, peptide) -> Column:
    """Zero-based position of the peptide in the sequence, -1 if absent."""
    return F.instr(_c(sequence), _c(peptide)) - F.lit(1)


def row_id(visit_id, target: str) -> Column:
    return F.concat_ws("_", _c(visit_id), F.lit(target))


def drop_existing(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])
