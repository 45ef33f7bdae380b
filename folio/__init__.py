"""Folio: dossier analytics as Spark jobs."""
