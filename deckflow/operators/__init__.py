"""Relational operators of the engine (feed, search, engagement, viewer, generation)."""
