"""Project files, their graph tables, and configuration."""
