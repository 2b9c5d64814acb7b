"""Operators that prepare training data; nothing else in plyforge imports this subpackage."""
