"""Operators for text corpora and learned signals; nothing outside this folder imports it."""
