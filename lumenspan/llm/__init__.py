"""Training-data operators: scans, filters, scores, near-duplicates and materialisation.

Nothing outside this subpackage imports it.
"""
