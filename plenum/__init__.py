"""Spark operators for scoring multi-agent answers and building preference data."""
