"""DataFrame -> DataFrame operators on panels."""
