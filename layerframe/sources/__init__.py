"""Readers and writers for images, tables, structures, configs and manifests."""
