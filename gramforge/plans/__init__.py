"""Matrix metadata, argument checks and tile sizes."""
