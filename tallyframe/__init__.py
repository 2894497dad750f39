"""Evaluation analytics over task, response and score tables, as Spark DataFrame operators."""
