"""braidset: reconcile overlapping snapshots of one relational data set on Spark."""
