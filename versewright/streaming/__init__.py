"""Streaming variants (beyond the batch operators)."""
