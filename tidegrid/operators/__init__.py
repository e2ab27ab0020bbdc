"""DataFrame operators on fields, series and encodings."""
