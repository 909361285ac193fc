"""Schemas of the tables, as DDL, in the order in which they are written."""

DETECTIONS = "game_id long, frame long, track_id long, class_id int, conf double, x1 float, y1 float, x2 float, y2 float"
CLIPS = "game_id long, fps double, width int, height int, total_frames long"
TRACKS = (
    "track_id long, role string, team int, team_conf double, player long, player_conf double, first_frame long, last_frame long, "
    "frames_seen long, seconds_on_surface double, active_seconds double, on_surface_frac double, median_area_px int"
)
PRESENCE = "track_id long, first_frame long, last_frame long, frames_seen long, seconds_on_surface double"
PLAYERS = (
    "player long, team int, n_shifts long, n_fragments long, track_ids string, frames_seen long, seconds_on_surface double, "
    "shift_seconds double, active_seconds double, longest_shift_s double, avg_shift_s double, first_frame long, last_frame long, mean_conf double"
)
SHIFTS = (
    "player long, team int, shift int, start_frame long, end_frame long, n_frames long, n_fragments long, start_time_s double, "
    "end_time_s double, duration_s double"
)
SEGMENTS = "segment int, start_frame long, end_frame long, n_frames long, start_time_s double, end_time_s double, duration_s double"
LABEL_TEMPLATE = (
    "track_id long, team string, role string, player string, pred_team string, pred_role string, frames_seen long, "
    "seconds_on_surface double, median_area_px int, crop string"
)
LABELS = "track_id string, team string, role string, player string, note string"
IDENTITIES = "segment int, local_id long, centroid array<double>, embedder string"


def names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]
