"""tidemark: panel analytics and corpus operators as lazy DataFrame functions on Spark."""
