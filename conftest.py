"""Puts the repository's root on the import path of the tests."""
