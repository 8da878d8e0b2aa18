"""weftline: link-and-retrieve analytics for replica catalogs and time axes on Spark."""
