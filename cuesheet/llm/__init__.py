"""Operators that prepare a text corpus for training. Nothing outside this subpackage imports it."""
