"""Event analytics on Spark: validate, enrich, score, decide, alert, report."""
