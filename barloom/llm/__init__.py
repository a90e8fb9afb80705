"""Training-data operators: search, quality, tokens, packing, near duplicates, licenses, languages.

Nothing outside this package imports it; the package may be deleted as a whole.
"""
