"""Followers of append-only tables and of changing source trees."""
