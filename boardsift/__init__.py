"""boardsift: analysis of two-colour 8x8 disc-flipping positions on Spark."""
