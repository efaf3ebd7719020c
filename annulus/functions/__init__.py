"""Part of annulus; see the README."""
