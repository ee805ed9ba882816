"""Operators for the text side of training data; nothing outside this subpackage imports it."""
