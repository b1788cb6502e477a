"""Training-data operators: one module for each, their queries in ``queries.py``.

Nothing else in the library imports this subpackage.
"""
