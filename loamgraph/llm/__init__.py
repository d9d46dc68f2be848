"""Operators for preparing text collections; nothing outside this folder imports it."""
