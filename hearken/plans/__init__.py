"""Whole jobs, built only from the operators."""
