"""Pair-similarity analytics on Spark: composable DataFrame -> DataFrame operators."""
