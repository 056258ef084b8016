"""Corpuscle: index code and text corpora into versioned chunk tables and query them, on Spark."""
