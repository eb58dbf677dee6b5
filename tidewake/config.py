"""Constants of the trajectory operators (fixed values: they must equal the published semantics)."""

NAUTICAL_MILE_M = 1852.0
RANGE_GATE_M = 2 * NAUTICAL_MILE_M
MIN_SPEED_KN = 0.3
JUMP_LON_DEG, JUMP_LAT_DEG, JUMP_SPEED_KN = 1.0, 1.0, 7.0
HISTORY_SECONDS = 120
FOV_MARGIN_DEG = 8.0

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
VINCENTY_EPS, VINCENTY_ROUNDS = 1e-12, 200

BIND_AFTER = 3
FORGET_AFTER_S = 3.0
UNREACHABLE = 1e9
BOUND_FACTOR = -100.0
MAX_HEADING_DIFF = 5.0 / 6.0
HEADING_POINTS = 10

MIN_TRACK_IOU, MAX_MISSED = 0.3, 3
DETECTOR_SIZE, DETECTOR_SCORE, DETECTOR_NMS = 640, 0.5, 0.3
FRAME_TOLERANCE_MS = 20

DEEP_MAX_COSINE, DEEP_MIN_CONFIDENCE, DEEP_MAX_IOU_DISTANCE = 0.2, 0.5, 0.7
DEEP_MAX_AGE, DEEP_CONFIRM_HITS, DEEP_BUDGET = 70, 3, 100
INFEASIBLE = 1e5
KALMAN_POSITION, KALMAN_VELOCITY = 1 / 20, 1 / 160
CHI2_2, CHI2_4 = 5.9915, 9.4877

EVAL_MIN_IOU, EVAL_SCORE_CUT = 0.5, 0.5
SPLIT_TRAINVAL, SPLIT_TRAIN = 0.95, 0.95
