"""Windloom: gridded, time-evolving vector fields and their experiments as Spark DataFrames."""
