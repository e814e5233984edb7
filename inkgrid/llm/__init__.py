"""Operators for training corpora; nothing else in the package imports this folder."""
