"""Readers and writers: audio files, asset listings, provider payloads."""
