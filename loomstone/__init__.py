"""loomstone package."""
