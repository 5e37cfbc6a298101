"""Relational operators over ordered, linked rows."""
