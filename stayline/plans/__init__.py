"""Whole-study tables put together from the operators."""
