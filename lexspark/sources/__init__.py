"""Readers and writers of the formats that the engine takes and gives."""
