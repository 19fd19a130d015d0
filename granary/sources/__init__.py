"""Readers for the tables a query runs on."""
