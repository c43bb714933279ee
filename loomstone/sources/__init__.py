"""loomstone.sources package."""
