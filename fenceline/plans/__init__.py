"""Whole pipelines composed from the operators, and the registered queries."""
