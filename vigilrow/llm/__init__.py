"""Operators for preparing training text: language, toxicity, duplicates, packing, storage.

Each module holds one operator with its own interface; ``catalog`` registers
one query for each.  Nothing outside this package imports it.
"""
