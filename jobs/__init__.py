"""Runnable jobs: each is a command line over a function that takes a session."""
