"""Sources of the tree library."""
