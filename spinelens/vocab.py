"""Fixed values shared by every operator (class order, spec tables, thresholds)."""

from __future__ import annotations

# Detector class order (index = class id), the femoral-head label and its merged id.
VERTEBRA_CLASSES = [
    "C7",
    "L1", "L2", "L3", "L4", "L5",
    "T1", "T2", "T3", "T4", "T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12",
]
CFH_LABEL = "CFH"
CFH_CLASS_ID = 18
MERGED_CLASSES = VERTEBRA_CLASSES + [CFH_LABEL]

# Labels left out of polygon completeness and of the pose build.
NON_POLYGON_LABELS = ["CFH", "S1", "T13"]

# Image extensions per stage, in the order in which a stage writes them.
AUDIT_EXTENSIONS = ["png", "jpg", "jpeg", "dcm"]
BUILD_EXTENSIONS = ["png", "jpg", "jpeg"]
PREDICT_EXTENSIONS = ["png", "jpg"]

# Thresholds and box sizes.
VERTEBRA_CONFIDENCE = 0.2
CFH_CONFIDENCE = 0.1
BATCH_CONFIDENCE = 0.25
SINGLE_CONFIDENCE = 0.5
KEYPOINT_CONFIDENCE = 0.5
POINT_BOX_PX = 64
BOX_MULTIPLIER = 1.8

# Defaults of a keypoints document.
DEFAULT_IMAGE_ID = "lateral_spine"
DEFAULT_STANDARD_DISTANCE = 100.0
DEFAULT_STANDARD_POINTS = [(0.0, 0.0), (200.0, 0.0)]

# Measurement types in output order.
MEASUREMENT_TYPES = [
    "T1 Slope", "C2-C7 CL", "TK T2-T5", "TK T5-T12", "LL L1-S1", "LL L1-L4",
    "LL L4-S1", "SVA", "TPA", "PI", "PT", "SS",
]
# Vertebrae that take part in a measurement.
MEASURED_LABELS = ["T1", "C2", "C7", "T2", "T5", "T12", "L1", "L4", "L5"]

# Metric names, in the order of MEASUREMENT_TYPES.
METRICS = [
    "T1_Slope", "Cervical_Lordosis", "Thoracic_Kyphosis_T2_T5", "Thoracic_Kyphosis_T5_T12",
    "Lumbar_Lordosis", "Lumbar_Lordosis_L1_L4", "Lumbar_Lordosis_L4_S1",
    "SVA", "TPA", "PI", "PT", "SS",
]
# The ten metrics of the coverage report, in report order.
REPORTED_METRICS = [
    "T1_Slope", "Cervical_Lordosis", "Thoracic_Kyphosis_T2_T5", "Thoracic_Kyphosis_T5_T12",
    "Lumbar_Lordosis", "SVA", "TPA", "PI", "PT", "SS",
]
# Metric names of the normalised calculator.
NORMALISED_METRICS = [
    "T1_slope", "cervical_lordosis", "thoracic_kyphosis_T2_T5", "thoracic_kyphosis_T5_T12",
    "lumbar_lordosis", "T1_pelvic_angle", "SVA", "pelvic_incidence", "pelvic_tilt",
    "sacral_slope",
]
