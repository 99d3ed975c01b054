"""tidecase: Spark DataFrame operators and jobs for cases that move through states over time."""
