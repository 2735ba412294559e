"""Writes: how a statement turns one state of the store into the next."""
