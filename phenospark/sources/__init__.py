"""Reading and writing of the engine's tables."""
