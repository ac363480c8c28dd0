"""Search plans: scans, and lookups through a stored index."""
