"""Reading, normalizing and writing features, catalogs and pixel tables."""
