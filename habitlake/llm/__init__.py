"""Training-data operators (op1 … op10); nothing else in the library imports this subpackage."""
