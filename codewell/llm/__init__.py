"""Operators for building and cleaning training corpora. Nothing outside this subpackage imports it."""
