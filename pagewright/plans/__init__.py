"""plans of pagewright."""
