"""Scan, image and archive readers and writers."""
