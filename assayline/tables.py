"""The three-table bundle the whole library works on."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional

from pyspark.sql import DataFrame

# Fixed values that must equal the reference's.
# Visit months accepted by the month report (months since baseline).
ALLOWED_MONTHS = (0, 3, 6, 9, 12, 18, 24, 30, 36, 42, 48, 54, 60, 72, 84)
# Default month of the cleaning steps.
DEFAULT_MONTH = 24
# Clinical score columns, in target order.
TARGETS = ("updrs_1", "updrs_2", "updrs_3", "updrs_4")
# Clinical column dropped before feature building.
MEDICATION_COL = "upd23b_clinical_state_on_medication"
# Join keys.
PROTEIN_KEYS = ("visit_id", "visit_month", "patient_id", "UniProt")
CLINICAL_KEYS = ("visit_id", "patient_id", "visit_month")


@dataclass(frozen=True)
class AssayTables:
    """proteins (visit_id, visit_month, patient_id, UniProt, NPX),
    peptides (... UniProt, Peptide, PeptideAbundance),
    clinical (visit_id, patient_id, visit_month, updrs_1..4, medication)."""

    proteins: DataFrame
    peptides: DataFrame
    clinical: DataFrame
    # Optional source-side month pruning (partition pruning of a layout
    # partitioned by month, or a pushable predicate the source can derive).
    month_pruner: Optional[Callable[[int], "AssayTables"]] = field(default=None, compare=False)

    def map(self, fn) -> "AssayTables":
        return AssayTables(fn(self.proteins), fn(self.peptides), fn(self.clinical))

    def pruned(self, month: int) -> "AssayTables":
        return self.month_pruner(month) if self.month_pruner else self
