"""quarry: a data-mining engine of composable DataFrame -> DataFrame operators on PySpark."""
