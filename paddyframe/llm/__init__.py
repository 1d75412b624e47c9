"""Training-data operators: language ID, scoring, encoding, deduplication, packing, extraction, search.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
registered queries and ``corpus_pipeline.py`` at the repository top chains four
of the operators.
"""
