"""Operators for preparing training text: extraction, scans, encoding, deduplication, scoring.

Nothing else in the library imports this folder. Every operator takes DataFrames and the
names of the columns it reads, ignores all other columns, and treats a null text as an
empty one. Each module says what it returns for nulls, empty tables and repeated rows.
"""
