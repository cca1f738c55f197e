"""functions of pagewright."""
