"""Sources: rasters from tables and images, value conversion and validation, persistence."""

from .convert import binarize, channel_first, check_same_shape, invert, resize_area, resize_nearest, scale, to_u8, validate_intensity, with_generated_target
from .raster import image_header, quantize, rasterize, rasterize_cells, read_images, read_prepared, write_prepared

__all__ = ["binarize", "channel_first", "check_same_shape", "image_header", "invert", "quantize", "rasterize", "rasterize_cells", "read_images", "read_prepared", "resize_area", "resize_nearest", "scale", "to_u8", "validate_intensity", "with_generated_target", "write_prepared"]
