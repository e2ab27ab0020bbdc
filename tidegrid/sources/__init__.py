"""Readers and writers of fields, series and encodings."""
