"""Column expressions shared by the models."""
