"""Prismatic: image-catalog analytics and corpus preparation on PySpark."""
