"""Operators over text for language-model training data; nothing outside this package uses them."""
