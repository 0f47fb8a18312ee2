"""Training-data operators: extraction, tokenising, scoring, sharding, near-duplicate search and filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
