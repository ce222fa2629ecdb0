"""Distributed operators. Every public function maps DataFrames to a lazy DataFrame."""
