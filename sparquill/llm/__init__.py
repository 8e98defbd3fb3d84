"""Operators on texts and logs for training-data work; nothing outside this subpackage imports it."""
