"""A property-graph and corpus analytics engine written for Spark."""
