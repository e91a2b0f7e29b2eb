"""PySpark operators for timed text, ranked results and street geometry."""
