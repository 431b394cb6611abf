"""Subpackage of stackmill."""
