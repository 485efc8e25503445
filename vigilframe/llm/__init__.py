"""Training-data operators: tokenizing, packing, fingerprints, scoring, dedup, formatting.

Nothing outside this subpackage imports it; removing the folder leaves the rest whole.
"""
