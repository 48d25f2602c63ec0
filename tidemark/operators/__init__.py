"""Operators over event, observation and version frames."""
