"""torusflow: a Spark-native analytics engine for periodic lattice structures, their
descriptors, their permeability labels and the model evaluation built on them."""
