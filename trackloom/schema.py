"""Fixed vocabulary, id ranges and default thresholds."""

from __future__ import annotations

from dataclasses import dataclass

MITOSIS, EXIT, DEATH, AMBIGUOUS, UNKNOWN = "Mitosis", "Exit", "Death/Senescence", "Ambiguous", "Unknown"
#: Fates that end a track.
FINAL = [MITOSIS, EXIT, DEATH, AMBIGUOUS]
EMPTY = ["", "nan", "None"]
NON_FLAG = [*EMPTY, UNKNOWN]

# Labels of other trackers and the fates that they mean; compared trimmed and in lower case.
TRANSLATIONS = {
    "fim": EXIT, "saida": EXIT, "saída": EXIT, "exit": EXIT,
    "mitose": MITOSIS, "mitosis": MITOSIS, "divisao": MITOSIS, "divisão": MITOSIS,
    "morte": DEATH, "senescencia": DEATH, "senescência": DEATH, "death": DEATH, "death/senescence": DEATH,
    "ambiguous": AMBIGUOUS, "ambiguo": AMBIGUOUS, "ambíguo": AMBIGUOUS, "ambigua": AMBIGUOUS, "ambígua": AMBIGUOUS,
    "indefinido": AMBIGUOUS, "incerto": AMBIGUOUS,
}
# Labels that mark a start and are dropped.
START_MARKERS = ["inicio", "início", "start", "begin", "nascimento"]

# Source names tried for each column, likeliest first.
CANDIDATES = {
    "track_id": ["track_id", "trackId", "TrackID", "TRACK_ID", "track", "particle", "label", "Label", "lineage", "spot_id", "cell_id", "Cell_ID", "CellID", "CELL_ID", "id", "ID"],
    "frame": ["frame", "Frame", "FRAME", "FRAME_INDEX", "t", "T", "time", "Time", "TIME", "POSITION_T", "timepoint", "time_point", "slice", "Slice"],
    "pos_x": ["pos_x", "x", "X", "POSITION_X", "centroid_x", "Centroid_X", "CENTROID_X", "centroid-1", "Center_of_the_object_0", "center_x", "Center_X", "x_pixel", "x_px", "XM"],
    "pos_y": ["pos_y", "y", "Y", "POSITION_Y", "centroid_y", "Centroid_Y", "CENTROID_Y", "centroid-0", "Center_of_the_object_1", "center_y", "Center_Y", "y_pixel", "y_px", "YM"],
    "outcome": ["Desfecho", "outcome", "Outcome", "OUTCOME", "fate", "Fate", "flag"],
    "parent_id": ["Parent_ID", "parent_id", "ParentID", "PARENT_ID", "mother_id", "MotherID", "parent", "Parent"],
}

# Source names tried for each column of a spots export.
SPOTS = {
    "track_id": ["TRACK_ID", "track_id", "TrackID"],
    "frame": ["FRAME", "POSITION_T", "frame", "t"],
    "pos_x": ["POSITION_X", "X", "x"],
    "pos_y": ["POSITION_Y", "Y", "y"],
}

# The ids of quarantined tracks.
QUARANTINE_FROM, QUARANTINE_TO = 1_000_000_000, 1_500_000_000


@dataclass(frozen=True)
class Thresholds:
    """The default limits of all checks."""

    min_valid_frames: int = 20
    max_jump_px: float = 40.0
    gap_tolerance: int = 1
    area_mad_k: float = 3.5
    min_solidity: float = 0.85
    max_eccentricity: float = 0.98
    mitosis_life_mad_k: float = 4.0
    relink_radius_px: float = 60.0
    swap_radius_px: float = 40.0
    swap_margin: float = 0.25
    swap_min_improvement_px: float = 1.0
    max_gap_fill: int = 12


# What a penalty takes from a track's score.
PENALTIES = {"no_outcome": 0.45, "jump": 0.30, "gap": 0.20, "incoherent": 0.25, "area_jump": 0.10}
