"""Structured streams of events."""
