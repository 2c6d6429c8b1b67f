"""assayline: longitudinal assay analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects,
so a whole month's work stays one logical plan for Catalyst and AQE.
"""

from assayline.tables import AssayTables, ALLOWED_MONTHS, DEFAULT_MONTH, TARGETS

__all__ = ["AssayTables", "ALLOWED_MONTHS", "DEFAULT_MONTH", "TARGETS"]
