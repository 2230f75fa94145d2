"""Training-data operators: classifiers, search, tokens, dedup, packing, sharding, scans.

Nothing else in the library imports this package. Operators take and return
DataFrames; ``tamis.llm.queries`` registers one query per operator.
"""
