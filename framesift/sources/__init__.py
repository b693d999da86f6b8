"""Readers and writers: annotation tables, subtitles, frame folders, caches, result logs."""
