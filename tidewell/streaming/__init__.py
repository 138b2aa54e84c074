"""Structured streaming of conversation turns into chunks, facts and marks, and event-time windows."""
