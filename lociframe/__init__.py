"""lociframe: genomic-prediction data jobs written as PySpark DataFrame operations."""
