"""axonframe: a Spark-first engine for querying large weighted graphs of neurons and synapses."""
