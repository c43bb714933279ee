"""loomstone.streaming package."""
