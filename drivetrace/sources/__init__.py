"""Readers that return typed DataFrames, and sinks."""
