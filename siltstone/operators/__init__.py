"""Statistics, text and vector operators over DataFrames."""
