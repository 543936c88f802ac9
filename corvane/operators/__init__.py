"""Operators on the relations of the engine: building the index, combining, filtering."""
