"""Readers that turn configurations, listings and label files into DataFrames."""
