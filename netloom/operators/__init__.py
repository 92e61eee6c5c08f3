"""Operators over DataFrames: interval joins, duplicates, splits, statistics, contracts, evidence."""
