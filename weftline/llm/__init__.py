"""Operators on texts for training corpora; nothing outside this package imports it."""
