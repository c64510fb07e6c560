"""Streaming intake of landed files."""
