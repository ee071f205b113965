"""Readers and writers: JSON documents, bulk lines, saved indexes."""
