"""Imports every query module so that the registry is filled."""

from registry import catalog, jobs, pitch, requests, signals, state, streams  # noqa: F401
