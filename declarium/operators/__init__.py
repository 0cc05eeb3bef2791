"""DataFrame-to-DataFrame operators; column names are parameters.

Encounter order is always an explicit column: no result depends on the order
of rows or partitions.
"""
