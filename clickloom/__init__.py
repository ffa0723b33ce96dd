"""Ad-click analytics as PySpark DataFrame operators, ML stages and streams."""
