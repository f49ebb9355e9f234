"""Structured Streaming twins of the stateful operators.

Watermarks and the treatment of late events are additions of this library.
"""
