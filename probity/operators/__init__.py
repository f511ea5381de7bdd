"""Forensic operators: DataFrame to DataFrame, with an explicit grouping key."""
