"""Readers for rules, tables, sitemaps and pages, and writers."""
