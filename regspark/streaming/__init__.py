"""Structured Streaming form of the resumable batch run."""
