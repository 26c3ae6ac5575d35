"""Helpers that shape execution: cut points, size-checked joins."""
