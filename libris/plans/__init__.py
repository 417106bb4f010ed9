"""Whole commands, made of operators over stored tables."""
