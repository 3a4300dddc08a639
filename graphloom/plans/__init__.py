"""Whole plans: parsing of files into tables, and the tools built on them."""
