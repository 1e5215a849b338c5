"""Operators for large text-corpus preparation; nothing outside this subpackage imports it."""
