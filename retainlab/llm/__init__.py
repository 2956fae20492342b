"""Training-data operators (deduplication, scoring, filtering, formatting, packing).

Nothing else in the library imports this subpackage; ``queries.py`` registers its
queries and ``__spark_entry__`` adds them when the subpackage is importable.
"""
