"""Operators for preparing training data, and the queries over them. Nothing else in the package imports this folder."""
