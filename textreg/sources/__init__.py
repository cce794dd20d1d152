"""Readers and writers for the file layouts the library works with."""
