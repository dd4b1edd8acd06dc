"""Training-data operators: dedup, language, URL and toxicity filters, mixing, tokenisation.

Nothing else in the library imports this package.
"""
