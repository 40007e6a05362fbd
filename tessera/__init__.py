"""Spark-native analytics for a board-game community: forum, games, retrieval and streams."""
