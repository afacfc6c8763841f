"""Training-data pipeline operators (dedup, packing, tokenising, scoring, PII, chat).

Nothing else in the library imports this subpackage; it may be removed whole.
"""
