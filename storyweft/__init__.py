"""Storyweft: grouping, checking and de-duplicating news text on Spark DataFrames."""
