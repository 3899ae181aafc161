"""DataFrame -> DataFrame operators: cleaning, fact build, views, metrics, quality."""
