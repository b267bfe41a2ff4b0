"""Mesh files as meshes, and meshes as files."""
