"""Touchline: league analytics as Spark jobs.

The package turns a wide match feed into a relational model, pulls scoring events out of
XML cells, and answers tally, arg-max, roster and rating questions. Every function takes
DataFrames and returns DataFrames.
"""
