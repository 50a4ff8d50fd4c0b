"""Readers of deck libraries."""
