"""Readers and writers for contract tables, JSON documents and run manifests."""
