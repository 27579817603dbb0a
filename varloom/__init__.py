"""varloom: a PySpark-native cohort-variant analytics engine."""
