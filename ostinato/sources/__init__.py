"""Readers and writers of files: listings, tags, audio, cue sheets, caches."""
