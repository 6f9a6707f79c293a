"""Ride-hail demand and driver analytics as DataFrame operators."""
