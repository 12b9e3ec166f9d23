"""Readers of intent documents and of recorded or paged provider payloads."""
