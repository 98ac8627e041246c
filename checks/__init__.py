"""Registered queries, their SQL twins and generated inputs."""
