"""DataFrame to DataFrame steps over the flat document tables."""
