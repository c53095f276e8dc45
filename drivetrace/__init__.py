"""Driving-telemetry analytics as Spark DataFrame functions.

``sources`` read telemetry, legs, exported CSV and position logs into typed DataFrames,
``operators`` are DataFrame-in / DataFrame-out building blocks, ``plans`` compose them into whole
runs.  Nothing here collects data: every function returns a lazy DataFrame.
"""
