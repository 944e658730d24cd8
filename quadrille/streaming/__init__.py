"""Window features of tiles that arrive as a stream of files."""
