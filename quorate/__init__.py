"""Roll-call and corpus analytics as lazy Spark DataFrame operators."""
