"""From TypeScript and JavaScript text to graph tables."""
