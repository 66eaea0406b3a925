"""Operators for large text-training corpora. Nothing outside this folder imports it."""
