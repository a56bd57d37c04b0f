"""Reading facts, and writing and swapping state tables."""
