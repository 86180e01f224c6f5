"""Skill-graph construction, audit and evaluation on Spark DataFrames."""
