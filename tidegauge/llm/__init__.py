"""Operators on document texts: packing, mixing of sources, scoring of abusive content."""
