"""The masked autoencoder: its arithmetic within a block of nodes or links."""
