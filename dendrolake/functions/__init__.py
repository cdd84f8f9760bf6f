"""Functions of the tree library."""
