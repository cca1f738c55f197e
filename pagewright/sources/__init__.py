"""sources of pagewright."""
