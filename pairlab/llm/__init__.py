"""Training-data operators: corpus operators, their queries and their SQL.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
