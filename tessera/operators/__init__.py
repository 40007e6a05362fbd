"""Relational operators of the community, its games and its chats."""
