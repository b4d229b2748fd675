"""Data-mining operators for tables and series, expressed as Spark DataFrame plans."""
