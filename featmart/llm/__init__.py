"""Operators for preparing training text: deduplication, archives, personal data, page
extraction, mixing, token output, decontamination, and quality decisions.

Nothing else in the library imports this package.
"""
