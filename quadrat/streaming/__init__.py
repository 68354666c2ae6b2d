"""Windowed and stateful stream processing."""
