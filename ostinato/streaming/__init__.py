"""Stateful operators over streams of frames and events."""
