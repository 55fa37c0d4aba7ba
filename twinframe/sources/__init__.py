"""Readers and writers of AAS documents."""
