"""Shared physical shapes: exact percentiles, blocked top-k, shared work folder."""
