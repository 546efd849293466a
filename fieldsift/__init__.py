"""fieldsift: corridor analytics and corpus preparation as PySpark jobs."""
