"""Whole analyses, registered queries and their SQL twins."""
