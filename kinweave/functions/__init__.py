"""Column functions: scalar text, phonetics, similarity, tags."""
