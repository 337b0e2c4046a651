"""Whole conversions, put together from sources and operators."""
