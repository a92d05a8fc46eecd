"""Readers of conversation stores into one record shape, discovery of their files, and sinks."""
