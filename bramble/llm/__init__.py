"""Training-data operators: ten corpus-scale building blocks on Spark DataFrames.

Nothing outside this package imports it.  Every operator works over whole
tables and whole texts, cuts lineage only through written tables in the shared
checkpoint folder, and states its handling of nulls, empty texts and repeated
rows in its docstring.
"""
