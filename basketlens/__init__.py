"""Shop-session analytics on Spark: clean, profile, slice, segment and report."""
