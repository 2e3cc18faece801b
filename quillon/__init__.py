"""quillon: machine-learning, sequence and mining operators as Spark DataFrame transformations."""
