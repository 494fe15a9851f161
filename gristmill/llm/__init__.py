"""Operators for preparing training text: counting, judging, matching, scanning, encoding and packing."""
