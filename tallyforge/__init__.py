"""Tallyforge: forecasting, scoring and evidence analytics over dated records, written as Spark DataFrame plans."""
