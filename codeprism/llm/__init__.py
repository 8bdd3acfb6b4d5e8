"""Operators for training data made of source files and text; nothing outside this package imports it."""
