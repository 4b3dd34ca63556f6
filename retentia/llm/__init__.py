"""Operators for preparing language-model training data, each in its own module.

``queries.py`` holds the named queries (spark, sf_dir) -> DataFrame.  Nothing
else in the library imports this subpackage.
"""
