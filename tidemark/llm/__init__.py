"""Training-data operators: dedup, tokenising, classifiers, search, packing and extraction.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it can be imported.
"""
