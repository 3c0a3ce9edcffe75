"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` wires them to the supplied tables.
"""
