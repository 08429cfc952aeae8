"""lodestream: composable PySpark operators for search-relevance and knowledge-graph data."""
