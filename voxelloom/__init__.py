"""Volume-label analytics as ordinary Spark plans."""
