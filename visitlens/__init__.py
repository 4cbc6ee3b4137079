"""Behaviour analytics on PySpark: sessions, page flows, area rankings and ad clicks."""
