"""profilelake: Spark jobs over large collections of sensor profiles."""
