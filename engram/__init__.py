"""Associative memory graphs as DataFrame operators."""
