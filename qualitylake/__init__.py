"""qualitylake: code- and content-quality analytics over many repositories, as Spark jobs."""
