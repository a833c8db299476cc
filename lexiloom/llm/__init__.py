"""Training-data operators: crawl archives, list filters, scoring, packing, deduplication, search.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries.py`` holds the thin registered queries and their SQL.
"""
