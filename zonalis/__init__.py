"""Area statistics and large-scale table jobs expressed as PySpark DataFrames."""
