"""Workflow-history analytics on Spark DataFrames."""
