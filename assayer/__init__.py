"""Evaluation of free-text answers against structured ground truth, on Spark."""
