"""The frame table, the episode table and their contracts."""

from __future__ import annotations

from pyspark.sql import types as T

HAND = T.StructType(
    [
        T.StructField("box", T.ArrayType(T.FloatType()), False),
        T.StructField("conf", T.FloatType()),
        T.StructField("side", T.ByteType()),
        T.StructField("side_conf", T.FloatType()),
        T.StructField("kpts3d", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("wrist_rot", T.ArrayType(T.FloatType())),
        T.StructField("finger_rot", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("hand_mask", T.BinaryType()),
    ]
)
_INTRINSICS = ("fx", "fy", "cx", "cy", "xi", "pinhole_fx", "pinhole_fy", "pinhole_cx", "pinhole_cy")
_SIDES = ("left", "right")

#: One row for each video frame; later stages fill more columns, unset ones are null.
FRAME = T.StructType(
    [T.StructField("clip_id", T.StringType(), False), T.StructField("frame_id", T.IntegerType(), False), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("intr_model", T.StringType()), T.StructField("hands", T.ArrayType(HAND))]
    + [T.StructField(c, T.DoubleType()) for c in _INTRINSICS]
    + [T.StructField(c, T.ArrayType(T.ArrayType(T.FloatType()))) for c in ("cam_pose", "cam_pose_base")]
    + [T.StructField("arm_mask", T.BinaryType()), T.StructField("n_person_det", T.IntegerType()), T.StructField("narr", T.StructType([T.StructField(c, T.StringType()) for c in ("think", "left", "right", "bimanual")])), T.StructField("language", T.StringType()), T.StructField("state_qpos", T.ArrayType(T.FloatType()))]
    + [T.StructField(f"state_eef_{s}", T.ArrayType(T.FloatType())) for s in _SIDES]
    + [T.StructField(f"state_mask_{s}", T.BooleanType()) for s in _SIDES]
    + [T.StructField("retarget_cost", T.FloatType())]
    + [T.StructField(f"err_tip_mm_{s}", T.ArrayType(T.FloatType())) for s in _SIDES]
    + [T.StructField(f"{c}_{s}", T.FloatType()) for c in ("err_palm_mm", "err_local_dir") for s in _SIDES]
    + [T.StructField("err_ddq", T.ArrayType(T.FloatType())), T.StructField("err_cam_pos_mm", T.FloatType()), T.StructField("err_cam_rot_deg", T.FloatType()), T.StructField("overlay_valid", T.BooleanType())]
)

EPISODE = T.StructType(
    [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("observation.state", "action", "observation.state_eef_left", "observation.state_eef_right", "action_eef_left", "action_eef_right", "observation.state_cam_frame")]
    + [T.StructField("timestamp", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("frame_index", "episode_index", "index", "task_index", "annotation.human.coarse_action")]
    + [T.StructField("next.done", T.BooleanType()), T.StructField("next.reward", T.DoubleType())]
)
