"""Whole queries as DataFrame plans."""
