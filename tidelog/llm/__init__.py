"""Operators for preparing training data: quality, privacy, duplicates, mixing, sharding, tokens.

Nothing outside this package imports it. General helpers (scratch tables, the shared folder)
come from :mod:`tidelog.session`.
"""
