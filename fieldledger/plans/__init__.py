"""Whole dataflows (Q01-Q15) made of the operators."""
