"""Lazy pipelines, data-quality rules, source normalizers."""
