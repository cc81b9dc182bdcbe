"""Whole dataflows made of operators."""
