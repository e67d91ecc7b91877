"""Training-data operators: one module per operator, queries in `entry`.

Nothing else in the library imports this subpackage.
"""
