"""DataFrame -> DataFrame operators, chained with ``DataFrame.transform``."""
