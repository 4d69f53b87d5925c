"""The plan language, and its ways in (SQL, JSON) and out (DataFrames)."""
