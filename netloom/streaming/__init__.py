"""Streams: probes of a service monitor against attack windows (an addition of our own)."""
