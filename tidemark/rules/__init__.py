"""Rules: the built-in catalogue, and how they meet nodes."""
