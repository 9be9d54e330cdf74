"""Column functions over texts, URIs and vectors."""
