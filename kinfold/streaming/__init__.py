"""Streams of queries against a static corpus."""

from kinfold.streaming.queries import link_stream

__all__ = ["link_stream"]
