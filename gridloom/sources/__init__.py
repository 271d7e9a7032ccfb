"""Readers and injectable adapters for image and PDF inputs."""
