"""Training-data pipeline operators: quality, token counts, deduplication,
decontamination, tokenisation, toxicity and sharding of a document table.

Nothing else in the library imports this subpackage.
"""
