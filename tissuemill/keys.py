"""Default column names; every operator takes others as parameters."""

INSTANCE, REGION, CHANNEL, VALUE = "instance", "region", "c", "value"
GENE, LAYER, SIZE, ANNOTATION = "gene", "layer", "size", "annotation"
UNKNOWN = "unknown"
#: Pixel coordinates of a two-dimensional raster; prepend "z" for three dimensions.
YX = ("y", "x")
