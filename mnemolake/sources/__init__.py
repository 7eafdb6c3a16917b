"""Sources: table projection, note files and chunks, and importers."""
