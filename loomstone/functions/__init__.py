"""loomstone.functions package."""
