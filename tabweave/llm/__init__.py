"""Operators for preparing training data, one module per operator.

Nothing else in the library imports this package. Each module holds the
operator with its general interface and the thin query ``opN_<name>`` that
applies it to its whole table; ``registry`` lists the queries and their SQL.
"""
