"""Streaming: intentionally empty.

The checks are batch checks over finished loads; there is no watermark, window, state or late-data behaviour to
"""
