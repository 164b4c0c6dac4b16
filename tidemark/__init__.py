"""Spark-first forecasting by analogy and risk analytics over time-ordered bars."""
