"""Operators of a training-data pipeline over very large text corpora.

Each module holds one operator and the thin ``opN_*`` query that applies it to a whole table;
``registry`` collects the queries. Nothing else in the library imports this subpackage.
"""
