"""Scans: driver tables, text files, JSON issue lists, DOCX packages, object listings."""
