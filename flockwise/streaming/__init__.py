"""Intentionally empty: every input of this library is a finite table.

The analyses read whole files and drop events outside the requested window; they
define no watermark, no stream window and no state store, so no streaming operator
is offered.
"""
