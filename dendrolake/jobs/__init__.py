"""Jobs of the tree library."""
