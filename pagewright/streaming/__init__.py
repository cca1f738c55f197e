"""streaming of pagewright."""
