"""Files of several formats as DataFrames."""
