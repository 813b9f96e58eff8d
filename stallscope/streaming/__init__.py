"""Operators on streams of trace rows."""
