"""Operators for training data on entities and text; nothing outside this folder imports it."""
