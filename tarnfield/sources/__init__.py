"""Sources: files, markdown, golden queries."""
