"""Operators for preparing text for model training. Nothing outside this folder imports it."""
