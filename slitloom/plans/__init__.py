"""Named queries and the reconstruction plan."""
