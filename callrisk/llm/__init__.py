"""Training-data operators: ten distributed text operators and their registered queries.

Nothing else in the library imports this subpackage.
"""
