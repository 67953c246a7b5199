"""End-to-end jobs: one lazy plan each, without intermediate files."""
