"""Readers for landed JSON pages and for raw tables."""
