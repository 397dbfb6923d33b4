"""Training-data operators: token counts, scans, deduplication, packing, classifiers, retrieval and language-model scores.

Nothing else in the library imports this subpackage.
"""
