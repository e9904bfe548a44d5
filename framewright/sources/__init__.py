"""Bindings of tables as segmented sequences, and readers and writers of the archive formats."""
