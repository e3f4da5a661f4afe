"""weftlake: a PySpark-native engine that turns fetched pages, feeds and search results into analysis-ready tables."""
