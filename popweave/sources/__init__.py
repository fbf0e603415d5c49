"""Readers for landed public tables: delimited text, JSON responses, GeoJSON, web pages."""
