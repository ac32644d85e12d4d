"""waygrid: Spark operators for visual indoor positioning and wayfinding data."""
