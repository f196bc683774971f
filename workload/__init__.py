"""Arrivals and files that the checks put before the library's streams and scans."""
