"""Training-data operators: tokens, models, filters and de-duplication.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
