"""Readers: CSV text to records, stored records, JSON record text."""
