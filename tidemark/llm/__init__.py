"""Operators for preparing training text: quality, deduplication, decontamination, scoring, tokenizers."""
