"""Command line, HTTP and tool surfaces over the engine."""
