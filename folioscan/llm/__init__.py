"""Training-data operators: near-duplicate joins, language and quality models, PII, packing.

Nothing outside this subpackage imports it.
"""
