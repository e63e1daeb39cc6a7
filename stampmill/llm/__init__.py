"""Training-data operators: dedup, privacy, sharding, extraction, quality, tokens, licences, leaks, toxicity.

Nothing else in the package imports this subpackage. Every operator takes DataFrames, reads only the
columns named in its arguments (so clashing extra columns cannot matter) and returns a DataFrame.
"""
