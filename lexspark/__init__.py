"""Vocabulary mining, study logs and operational tables as DataFrame to DataFrame functions on Spark."""
