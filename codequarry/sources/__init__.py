"""Readers, writers and the binding of driver tables to the engine's inputs."""
