"""An analytics engine on PySpark: one small plan language, a snapshot catalog, statistics and text retrieval."""
