"""rupaka: rule-based morphological text analysis on Spark DataFrames."""
