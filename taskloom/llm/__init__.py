"""Training-data operators: mixing, search, joins, scoring, deduplication, tokenising and sharding.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` holds the registered
queries and ``oracles`` their SQL.
"""
