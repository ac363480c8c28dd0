"""Operators over terms, grams and postings."""
