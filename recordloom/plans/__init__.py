"""Jobs that write: loads, exports, the catalogue."""
