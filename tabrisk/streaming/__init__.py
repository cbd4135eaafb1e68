"""Applying fitted preparation to streaming DataFrames."""
