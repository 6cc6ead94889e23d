"""Reserved: the engine answers queries over bounded tables only, as its specification language has no streams."""
