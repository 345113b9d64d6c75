"""Scans: folders, path lists, record files, tables; and the extraction of text from files."""
