"""Sources of baskets and of spatial objects."""
