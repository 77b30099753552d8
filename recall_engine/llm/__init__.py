"""Operators for preparing language-model training data.

Every operator is a function from DataFrames to a DataFrame.  Nothing in the
rest of the library imports this package.
"""
