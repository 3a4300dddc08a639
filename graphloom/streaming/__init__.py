"""Incremental work as streams."""
