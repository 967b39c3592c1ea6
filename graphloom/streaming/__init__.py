"""Structured Streaming counterparts of the file-to-file stages."""
