"""DuckDB text of the flows, for the driver's oracle comparison.

Each function returns extra CTE definitions (comma-led) to append after
``ORACLE_CTES``; views ``lineitem``, ``orders``, ``part`` ... exist already.
"""

from __future__ import annotations

from assayline.sources.adapter import ORACLE_CTES

MED = "upd23b_clinical_state_on_medication"


def with_(*parts: str) -> str:
    return "WITH " + ORACLE_CTES + "".join(parts)


def joined(month: int = 24) -> str:
    return f""",
m_pep AS (SELECT * FROM peptides WHERE visit_month = {month}),
m_pro AS (SELECT * FROM proteins WHERE visit_month = {month}),
m_cli AS (SELECT * FROM clinical WHERE visit_month = {month}),
joined AS (
  SELECT a.visit_id, a.visit_month, a.patient_id, a.UniProt, a.Peptide, a.PeptideAbundance,
         b.NPX, c.updrs_1, c.updrs_2, c.updrs_3, c.updrs_4, c.{MED}
  FROM m_pep a
  LEFT JOIN m_pro b ON a.visit_id = b.visit_id AND a.visit_month = b.visit_month
                   AND a.patient_id = b.patient_id AND a.UniProt = b.UniProt
  LEFT JOIN m_cli c ON a.visit_id = c.visit_id AND a.patient_id = c.patient_id
                   AND a.visit_month = c.visit_month)"""


def nonnull(month: int = 24) -> str:
    cols = ["visit_id", "visit_month", "patient_id", "UniProt", "Peptide", "PeptideAbundance",
            "NPX", "updrs_1", "updrs_2", "updrs_3", "updrs_4", MED]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return joined(month) + f""",
dedup AS (SELECT DISTINCT * FROM joined),
nonnull AS (SELECT *, 0 AS null_count FROM dedup WHERE {cond})"""


def _iqr_clip(src: str, dst: str, col: str, other_cols: str) -> str:
    return f""",
{dst}_f AS (
  SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {src}),
{dst} AS (
  SELECT {other_cols},
         CASE WHEN {col} IS NULL THEN NULL
              ELSE least(greatest({col}, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS {col}
  FROM {src}, {dst}_f)"""


def _sigma_null(src: str, dst: str, col: str, other_cols: str) -> str:
    return f""",
{dst}_b AS (SELECT avg({col}) AS mu, stddev_samp({col}) AS sd FROM {src}),
{dst} AS (
  SELECT {other_cols},
         CASE WHEN {col} BETWEEN mu - 3 * sd AND mu + 3 * sd THEN {col} END AS {col}
  FROM {src}, {dst}_b)"""


def _ln(col: str) -> str:
    return (f"CASE WHEN {col} > 0 THEN ln({col}) WHEN {col} = 0 THEN CAST('-inf' AS DOUBLE) "
            f"END")


def clean(month: int = 24) -> str:
    """L1 with visit keys kept; final CTE ``cleaned``."""
    keys = "visit_id, visit_month, patient_id, UniProt, Peptide"
    scores = f"updrs_1, updrs_2, updrs_3, updrs_4, {MED}, null_count"
    base = nonnull(month)
    s = base
    s += _iqr_clip("nonnull", "c1", "NPX", f"{keys}, PeptideAbundance, {scores}")
    s += _iqr_clip("c1", "c2", "PeptideAbundance", f"{keys}, NPX, {scores}")
    s += f""",
c3 AS (SELECT *, {_ln('NPX')} AS NPX_log, {_ln('PeptideAbundance')} AS PeptideAbundance_log FROM c2)"""
    logs = "NPX_log, PeptideAbundance_log"
    s += _iqr_clip("c3", "c4", "NPX", f"{keys}, PeptideAbundance, {scores}, {logs}")
    s += _iqr_clip("c4", "c5", "PeptideAbundance", f"{keys}, NPX, {scores}, {logs}")
    s += _sigma_null("c5", "c6", "NPX", f"{keys}, PeptideAbundance, {scores}, {logs}")
    s += _sigma_null("c6", "c7", "PeptideAbundance", f"{keys}, NPX, {scores}, {logs}")
    s += f""",
cleaned AS (
  SELECT visit_id, visit_month, patient_id, UniProt, Peptide, PeptideAbundance, NPX,
         updrs_1, updrs_2, updrs_3, updrs_4, NPX_log, PeptideAbundance_log FROM c7)"""
    return s


STATS = ("mean", "median", "min", "max", "std", "var")
TARGETS = ("updrs_1", "updrs_2", "updrs_3", "updrs_4")
_AGG = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "min": "min({c})",
        "max": "max({c})", "std": "stddev_samp({c})", "var": "var_samp({c})"}


def _ratio(a: str = "PeptideAbundance", b: str = "NPX") -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} <> 0 THEN {a} / {b} "
            f"WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) END")


def _avg_rank(col: str, part: str | None = None) -> str:
    p = f"PARTITION BY {part} " if part else ""
    tie = f"PARTITION BY {part + ', ' if part else ''}{col}"
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE rank() OVER ({p}ORDER BY {col}) + "
            f"(count(*) OVER ({tie}) - 1) / 2.0 END")


def features(month: int = 24, keep_keys: bool = False) -> str:
    """L1 + L2; final CTE ``feat`` (45 columns, plus visit keys when asked)."""
    s = clean(month)
    g = ", ".join(f"{_AGG[st].format(c='NPX_log')} AS g_{st}" for st in STATS)
    u = ", ".join(f"{_AGG[st].format(c='PeptideAbundance_log')} AS u_{st}" for st in STATS)
    t = ", ".join(f"{_AGG[st].format(c=tc)} AS {tc}_{st}" for tc in TARGETS for st in STATS)
    keys = "r.visit_id, r.visit_month, r.UniProt, r.Peptide, " if keep_keys else ""
    s += f""",
f0 AS (SELECT *, {_ratio()} AS Peptide_per_Protein FROM cleaned),
g AS (SELECT {g}, count(NPX_log) AS g_n FROM f0),
u AS (SELECT UniProt, {u}, count(PeptideAbundance_log) AS u_n FROM f0 GROUP BY UniProt),
t AS (SELECT {t} FROM f0),
r AS (SELECT f0.*, {_avg_rank('NPX_log')} AS rk_npx,
             {_avg_rank('PeptideAbundance_log', 'UniProt')} AS rk_pa FROM f0),
feat AS (
  SELECT {keys}r.updrs_1, r.updrs_2, r.updrs_3, r.updrs_4, r.NPX_log, r.PeptideAbundance_log,
         r.Peptide_per_Protein,
         r.rk_npx / g.g_n AS NPX_log_percentile_in_all,
         {", ".join(f"g.g_{st} AS NPX_log_{st}_in_all" for st in STATS)},
         r.rk_pa / u.u_n AS PeptideAbundance_log_percentile_in_local,
         {", ".join(f"u.u_{st} AS PeptideAbundance_log_{st}_in_UniProt" for st in STATS)},
         {", ".join(f"t.{tc}_{st}" for tc in TARGETS for st in STATS)}
  FROM r CROSS JOIN g CROSS JOIN t LEFT JOIN u ON r.UniProt = u.UniProt)"""
    return s


FEATURE_DOUBLES = (
    ["NPX_log", "PeptideAbundance_log", "Peptide_per_Protein", "NPX_log_percentile_in_all"]
    + [f"NPX_log_{st}_in_all" for st in STATS]
    + ["PeptideAbundance_log_percentile_in_local"]
    + [f"PeptideAbundance_log_{st}_in_UniProt" for st in STATS]
    + [f"{tc}_{st}" for tc in TARGETS for st in STATS])


def exact_mean(col: str) -> str:
    """Mean of a cent-valued, non-negative column rounded half-up to 6
    places in integer arithmetic: Spark's avg(decimal(18,2)) to the bit."""
    cents = f"CAST(round({col} * 100) AS BIGINT)"
    return (f"CAST((2 * sum({cents}) * 10000 + count({col})) // (2 * count({col})) AS DOUBLE)"
            f" / 1000000")


def bucket(seed: int, *keys: str) -> str:
    """DuckDB twin of ``hash_bucket``."""
    cat = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {cat})), 1, 8) AS BIGINT) % 10000)"


def row_hash(seed: int, *keys: str) -> str:
    cat = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {cat}))"


def split_case(test: float = 0.2, val: float = 0.0, seed: int = 42,
               keys=("visit_id", "UniProt", "Peptide"), units: bool = False) -> str:
    """Exact sizes by the order of hashes; ``units``: the keys are split, not the rows."""
    h = row_hash(seed, *keys)
    n = f"(count(DISTINCT {h}) OVER ())" if units else "(count(*) OVER ())"
    r = f"(dense_rank() OVER (ORDER BY {h}))" if units else f"(row_number() OVER (ORDER BY {h}))"
    nt = f"ceil({test}::DOUBLE * {n})"
    nv = f"ceil({val}::DOUBLE * ({n} - {nt}))"
    return (f"CASE WHEN {r} <= {nt} THEN 'test' WHEN {r} <= {nt} + {nv} THEN 'val' "
            f"ELSE 'train' END")


def prepared(month: int = 24, test: float = 0.2, val: float = 0.0, seed: int = 42) -> str:
    """features with keys + split + min-max scaling fitted on train: CTE ``prep``."""
    s = features(month, keep_keys=True)
    mm = ", ".join(f"min({c}) AS {c}__lo, max({c}) AS {c}__hi" for c in FEATURE_DOUBLES)
    sc = ", ".join(
        f"(sp.{c} - mm.{c}__lo) / (CASE WHEN mm.{c}__hi - mm.{c}__lo = 0 THEN 1.0 "
        f"ELSE mm.{c}__hi - mm.{c}__lo END) AS {c}" for c in FEATURE_DOUBLES)
    s += f""",
sp AS (SELECT *, {split_case(test, val, seed)} AS split FROM feat),
mm AS (SELECT {mm} FROM sp WHERE split = 'train'),
prep AS (SELECT sp.visit_id, sp.visit_month, sp.UniProt, sp.Peptide, sp.split,
                sp.updrs_1, sp.updrs_2, sp.updrs_3, sp.updrs_4, {sc}
         FROM sp CROSS JOIN mm)"""
    return s
