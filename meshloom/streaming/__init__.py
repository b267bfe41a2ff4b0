"""Streams of tag updates."""
