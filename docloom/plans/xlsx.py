"""Workbooks to Markdown."""

from docloom.operators.sheets import markdown

__all__ = ["markdown"]
