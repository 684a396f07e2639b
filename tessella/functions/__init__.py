"""Column builders: text, links, hashes, usage."""
