"""Operators of a large-scale text pipeline; nothing outside this subpackage imports it."""
