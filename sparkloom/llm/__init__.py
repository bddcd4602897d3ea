"""Training-data operators: scoring, search, archives, fingerprints, formatting, filters, joins and packing.

Nothing outside this folder imports it. ``queries.py`` holds the thin queries that ``__spark_entry__`` adds when the
folder is there.
"""
