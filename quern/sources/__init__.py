"""Readers, writers and transports."""
