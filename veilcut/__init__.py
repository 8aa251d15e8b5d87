"""Referential subsetting, deterministic masking and verification of related tables on Spark."""
