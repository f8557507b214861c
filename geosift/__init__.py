"""Registers of located facilities as lazy Spark plans."""
