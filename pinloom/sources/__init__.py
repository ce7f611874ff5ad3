"""Readers: tables of a data folder, blobs, lines, manifests."""
