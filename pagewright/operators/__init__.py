"""operators of pagewright."""
