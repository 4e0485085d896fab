"""Keystroke streams: debounce and stream-static search."""
