"""Readers of match files and keyed tables, and the sinks that keep tables whole."""
