"""Training-data operators (problems 1 to 8). Nothing else in the library imports this subpackage."""
