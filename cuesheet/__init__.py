"""Timeline analytics as Spark DataFrames: intervals, as-of joins, frame windows, sequence folds, label rules and reports."""
