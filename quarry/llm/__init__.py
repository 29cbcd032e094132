"""Operators for large training corpora; nothing else in quarry imports this subpackage."""
