"""loomstone.operators package."""
