"""Colloquy: conversational-memory analytics as Spark dataflows."""
