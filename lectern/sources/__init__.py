"""Readers and writers: folders of notes, web pages, event lines, snapshots, backups."""
