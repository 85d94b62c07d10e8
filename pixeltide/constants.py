"""Fixed values shared by the operators. They must stay as they are for results to agree."""

# Depth written for a ray that hit nothing, and the thresholds that call a pixel "sky".
MISS_DEPTH = 1e30
SKY_DEPTH_FLOW = 1e29
SKY_DEPTH_COVERAGE = 1e28

# Valid-depth windows of the point cloud and of the training losses.
CLOUD_DEPTH_EPS = 1e-3
TRAIN_DEPTH_MIN = 1e-6
TRAIN_DEPTH_MAX = 1e6

# Camera-space depth at or below this is behind the camera.
FRONT_Z_EPS = 1e-9

# Largest id a float32 channel holds exactly.
MAX_F32_ID = 16777215

# Names of the aggregate annotation documents looked for under a dataset root.
COCO_SECTIONS = ("images", "annotations", "categories")
COCO_DEFAULT_NAMES = ("annotations_coco.json", "scenario_coco.json")

# Sidecar suffixes of one frame.
SIDECAR_SUFFIXES = (".png", "_spatial.exr", "_meta.json", ".txt")

# Frame-name patterns. Numbers are padded to four digits and grow beyond; the strict form takes exactly four.
IMAGE_NAME_STRICT = r"^(frame|sfrm)_(\d{4})\.png$"
IMAGE_NAME_OPEN = r"^(frame|sfrm)_(\d{4,})\.png$"
META_NAME_STRICT = r"^(frame|sfrm)_(\d{4})_meta\.json$"
META_NAME_OPEN = r"^(frame|sfrm)_(\d{4,})_meta\.json$"

# Validation thresholds.
MAX_BBOX_AREA_FRAC = 0.95
MIN_BBOX_AREA_PIXELS = 1
MIN_IMAGE_BYTES = 1
BBOX_EDGE_EPS = 1e-6

# Frame sidecar: fixed convention strings.
META_CAMERA_TO_WORLD = "row_major_4x4"
META_HANDEDNESS = "right"
META_OBJECT_NOTE = (
    "local_to_world_row_major_is_RzRyRx_times_scale_plus_translation_only;"
    "flat_pack_slope_alignment_and_vertex_snap_omitted_when_grounding"
)
META_PIXEL_RAY = "s=i/max(W-1,1),t=j/max(H-1,1)_via_Camera::get_ray"
SUPERVISION_GROUNDED = "logical_excludes_slope_and_vertex_snap"
SUPERVISION_FREE = "logical_matches_baked_mesh"

MANIFEST_SCHEMA_VERSION = "2"
