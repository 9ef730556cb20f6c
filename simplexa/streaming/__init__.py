"""Points that arrive later: placed by interpolation between embedded neighbours, one micro-batch after the other."""
