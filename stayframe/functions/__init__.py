"""Part of stayframe."""
