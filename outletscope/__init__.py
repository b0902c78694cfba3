"""Outlet market-share analytics as PySpark DataFrame jobs."""
