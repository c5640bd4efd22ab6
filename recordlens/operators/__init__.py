"""Relational operators of the engine, DataFrame in and DataFrame out."""
