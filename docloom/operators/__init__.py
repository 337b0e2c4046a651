"""Relational operators over decoded documents."""
