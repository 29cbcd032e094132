"""DataFrame -> DataFrame operators with generic column names."""
