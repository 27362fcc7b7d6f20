"""Run events and messages as streams; each function also takes a batch DataFrame."""
