"""Operators for preparing language-model training data; nothing else in clearstack imports this subpackage."""
