"""Column functions: vector algebra and activations over arrays of doubles."""
