"""Operators on genotype, phenotype and prediction tables: DataFrames in, DataFrames out."""
