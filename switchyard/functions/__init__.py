"""Scalar building blocks: ``Column`` in, ``Column`` out, all inside JVM expressions."""
