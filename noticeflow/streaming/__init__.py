"""Continuous maintenance with Structured Streaming."""
