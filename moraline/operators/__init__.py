"""DataFrame operators of the conversion and language-modelling pipeline."""
