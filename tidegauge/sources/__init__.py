"""Readers and writers: tables, text side inputs and the packed binary formats."""
