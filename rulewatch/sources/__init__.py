"""Readers and writers: control tables, archives, exports, health."""
