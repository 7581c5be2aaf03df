"""The tables of the engine, as DDL. Frames that may be empty are always typed by these."""

PATCH_INDEX = "volume_id string, source_group string, split string, z0 long, y0 long, x0 long, ps long, stride long, porosity float"
SPLITS = "volume_id string, split string"
VOLUME_STATS = "volume_id string, mean double, std double, n_foreground long, otsu_threshold int"
VOXELS = "volume_id string, z int, y int, x int, v int"
VOLUME_CHUNKS = "volume_id string, cz int, cy int, cx int, d int, h int, w int, xct binary, mask binary"
SPLIT_NAMES = ("train", "val", "test")
