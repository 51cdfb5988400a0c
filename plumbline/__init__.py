"""plumbline: schedule-versus-progress analytics expressed as Spark DataFrame plans."""
