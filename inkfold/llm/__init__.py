"""Operators for preparing training data.

Nothing else in the library imports this subpackage; of the rest it uses the shared tables (``plans.shared``) only.
``queries.py`` registers one query for each operator.
"""
