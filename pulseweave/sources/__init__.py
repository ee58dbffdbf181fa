"""Readers and writers: metadata, waveform records, manifests, result tables."""
