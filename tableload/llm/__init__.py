"""Operators for training-data pipelines: near-duplicates, secrets, token counts, language-model scores, BPE, packing,
nearest neighbours, quality, toxicity, exact top-k search, id files, collocations and vector codes.

Nothing else in the library imports this subpackage. ``queries`` holds the queries over the given tables.
"""
