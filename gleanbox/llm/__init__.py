"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
