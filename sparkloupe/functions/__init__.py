"""Column functions and the shared source parse."""
