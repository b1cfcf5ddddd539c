"""Runnable jobs on top of the library; each has a command line, a small config file and a function of a session."""
