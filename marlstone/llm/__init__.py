"""Training-data operators: each is a DataFrame -> DataFrame function.

Nothing else in the library imports this subpackage.
"""
