"""Plans: session settings, materialisation, the pipeline and the query registry."""
