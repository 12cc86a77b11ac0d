"""Cohort analytics on Spark: entity resolution, feature tables, scoring, splits, fusion."""
