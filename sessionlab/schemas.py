"""Fixed schemas. Nothing is inferred; absent values are NULL."""

from pyspark.sql import types as T


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


# Observation kinds (fixed values of the record format).
SESSION_START, SESSION_END, RESET, TICK, DIG, MINING = 1, 2, 3, 4, 5, 6
ATTACK, COMBAT, SWING, TELEPORT, MOVE, IMPULSE, IMPULSE_ACK, CORRECTION = 7, 8, 9, 10, 11, 12, 13, 14

# One row per observation, wide and flat so that scans prune to the columns they need.
OBS_DDL = """
trial string, session bigint, ordinal bigint, ns bigint, epoch_ms bigint, server_tick bigint, kind int,
player string, protocol int, model int, reason string,
packet bigint, batch bigint, sampled_ns bigint, world string, available boolean,
action int, face int, bx int, by int, bz int, state_key string, block string, tool string, damage double,
target string, target_kind string, target_id int,
eye_x double, eye_y double, eye_z double, low_x double, low_y double, low_z double,
high_x double, high_y double, high_z double, ping int, rotation boolean, target_player boolean,
x double, y double, z double, yaw double, pitch double, has_pos boolean, has_look boolean, ground boolean,
source boolean, destination boolean, clear boolean, flat boolean, item boolean, sprint boolean,
speed double, friction double, jump double,
token bigint, vx double, vy double, vz double, additive boolean,
cause string, from_world string, to_world string,
from_x double, from_y double, from_z double, to_x double, to_y double, to_z double
"""

MANIFEST_DDL = """
boot_id string, player_uuid string, declared_label string, module string, client string, setting string,
scenario string, verification string, trial_id string, status string, end_reason string,
session_id bigint, start_observed_ns bigint, start_epoch_ms bigint, guard_ms bigint,
end_observed_ns bigint, end_epoch_ms bigint, records bigint, uncompressed_bytes bigint, chunks bigint
"""

FINDING_DDL = """
level string, check string, player string, session string, event string, observed_ns string,
epoch_ms string, server_tick string, message string, evidence map<string,string>
"""

BEHAVIOR_FEATURES = [
    "movement_pps", "movement_cv", "attack_pps", "attack_cv",
    "attack_repeat", "ground_fraction", "turn_mean", "attacks",
]
