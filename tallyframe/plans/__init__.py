"""Whole queries and evaluation runs."""
