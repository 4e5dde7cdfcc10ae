"""Column functions with one rule for missing values: NULL, never NaN."""
