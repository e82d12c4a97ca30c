"""Container and codestream readers: bytes in, rows out."""
