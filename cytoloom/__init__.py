"""Single-cell sequencing analytics and corpus preparation as Spark DataFrame programs."""
