"""Readers of collected payloads and the folder for staged tables."""
