"""Column-expression helpers (JVM-side, codegen-friendly; no Python UDFs)."""

from assayline.functions.scalar import (  # noqa: F401
    safe_ln, safe_div, clip, nan_to_null, hash_bucket, round_half_even,
    residual, error, peptide_position, row_id, drop_existing,
)
