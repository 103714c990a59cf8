"""Operators over baskets, itemsets and spatial objects."""
