"""Training-data operators: URL filters, secret scans, decontamination, mixing, dedup, search, tokens, quality, chat.

Self-contained: nothing outside this subpackage imports it.
"""
