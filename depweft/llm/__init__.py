"""Operators on names and texts for training data: canonical names, leaked items, mixtures, sentences."""
