"""Readers: bytes to rows."""
