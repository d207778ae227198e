"""Training-data operators: ten document-scale operators and their driver queries.

Nothing outside this subpackage imports it.
"""
