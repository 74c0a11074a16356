"""Readers, writers and the adapters that map the given tables onto workflow event logs."""
