"""loomstone.plans package."""
