"""Numeric functions and caption rules against hand-made and plain cases."""

import numpy as np
import pytest

from framewright.functions import captions as C
from framewright.functions import masks
from framewright.functions import quaternions as Q


def rotation(rng):
    return Q.unit(rng.standard_normal((50, 4)))


def test_matrices_round_trip():
    q = rotation(np.random.default_rng(0))
    q = np.where(q[:, 3:] < 0, -q, q)
    r = Q.to_matrix(q)
    assert np.allclose(r @ np.swapaxes(r, -1, -2), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    assert np.allclose(Q.from_matrix(r), q, atol=1e-9)
    assert np.allclose(Q.to_matrix(Q.from_axis_angle(np.array([0, 0, np.pi / 2]))) @ [1, 0, 0], [0, 1, 0])
    assert np.allclose(Q.rpy(0, 0, np.pi / 2) @ [1, 0, 0], [0, 1, 0])


def test_slerp_halfway_and_ends():
    a, b = Q.from_axis_angle(np.array([0.0, 0, 0])), Q.from_axis_angle(np.array([0, 0, 1.0]))
    assert np.allclose(Q.slerp(a, b, 0.5), Q.from_axis_angle(np.array([0, 0, 0.5])))
    assert np.allclose(Q.slerp(a, -b, 1.0), b)
    assert np.allclose(Q.mean(np.stack([a, -a, a])), a)


def test_interpolation_copies_ends():
    q = np.tile(Q.from_axis_angle(np.array([0.0, 0, 0])), (5, 1))
    q[3] = Q.from_axis_angle(np.array([0, 0, 1.0]))
    t = np.array([[0.0] * 3, [0] * 3, [0] * 3, [4.0] * 3, [0] * 3])
    a, b = Q.interpolated(np.array([0, 1, 2, 5, 6.0]), q, t, np.array([False, True, False, True, False]))
    assert np.allclose(b[:, 0], [0, 0, 1, 4, 4]) and np.allclose(a[2], Q.from_axis_angle(np.array([0, 0, 0.25])))


def test_sim3_finds_a_known_transform():
    rng = np.random.default_rng(1)
    q, t = rotation(rng), rng.standard_normal((50, 3))
    r = Q.to_matrix(Q.from_axis_angle(np.array([0.1, 0.2, 0.3])))
    s, got, back = Q.sim3(q, t, Q.from_matrix(r @ Q.to_matrix(q)), 1.5 * t @ r.T + [1, 2, 3])
    assert np.isclose(s, 1.5) and np.allclose(got, r) and np.allclose(back, [1, 2, 3])


def test_smoothing_leaves_constants_and_robust_median():
    q = np.tile(Q.from_axis_angle(np.array([0.3, 0, 0])), (20, 1))
    assert np.allclose(Q.smoothed(q, np.ones(5) / 5), q)
    assert Q.robust_median(np.array([[1.0], [2], [3], [4], [100]]))[0] == 2.5
    assert Q.up_vector(np.eye(3)[:2]) is None and np.allclose(Q.up_vector(np.array([[0, 0, 1.0], [0, 0, -1], [0, 0, 1]])), [0, 0, 1])


def test_mask_codec():
    m = np.array([[1, 0], [0, 1]])
    assert masks.encode(m).hex() == "424d4b31" + "00000002" * 2 + "90" and (masks.decode(masks.encode(m)) == m).all()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("open the jar , and then close it", "open the jar and close it"),
        ("A,B , and C", "A, B and C"),
    ],
)
def test_punctuation(text, want):
    assert C.punctuation(text) == want


def test_phrases():
    assert C.phrases("open the jar and close it") == ["open the jar", "close it"]
    assert C.phrases("mix salt and pepper") == ["mix salt and pepper"]
    assert C.phrases("pick the red and place it") == ["pick the red and place it"]
    assert C.phrases("open a, close b, lift c, push d") is None
    assert C.phrases("open a, close b, lift c, push d", cut=True) == ["open a", "close b", "lift c"]
    assert C.joined(["a", "b", "c"]) == "a, b and c" and C.joined(["a", "b"]) == "a and b" and C.joined(["a"]) == "a"


def test_object_classes():
    want = {"the jar": "concrete", "metal tool": "appearance_only", "item": "bare_vague", "food": "bare_soft_vague", "paint container": "typed_generic", "the": "none", "larger thing": "appearance_only", "yellow-capped object": "appearance_only"}
    assert {k: C.object_class(tuple(k.split())) for k in want} == want


def test_normal_form():
    assert C.normal_form('"Opens the jar with a knife."') == "open the jar"
    assert C.normal_form("picks the knife and places the knife on the table") == "pick the knife and place it on the table"
    assert C.normal_form("holding the jar and opened it") == "open the jar"
    assert C.normal_form("No action") == "n/a" and C.normal_form(" ") == "n/a"


def test_reasons():
    assert C.phrase_reason("touch the jar") == "non_manipulation_verb" and C.phrase_reason("open the thing") == "vague_object"
    assert C.phrase_reason("hold the jar") == "non_manipulation_verb" and C.phrase_reason("hold the jar", True) is None
    assert C.phrase_reason("open") == "fmt_structural" and C.phrase_reason("open their jar") == "bad_pronoun" and C.phrase_reason("move the dot") == "overlay_hallucination"
    assert C.caption_reason("open it") == "fmt_structural" and C.caption_reason("open the jar and close it") is None


def test_fields():
    out, why, end = C.validated({"left": "open the jar, touch the lid and push it", "right": "right hand lifts it", "bimanual": "fold the towel"})
    assert out["left"] == "open the jar" and why["right"] == "cross_hand_leakage" and why["bimanual"] == "bimanual_noun_mismatch" and end is None
    assert C.validated({"left": "hold the jar", "right": None, "bimanual": "n/a"})[2] == "all_na"
    out, why, flags = C.postchecked({"left": "open the lid", "right": "n/a", "bimanual": "lift the round object"})
    assert out["bimanual"] == "lift the round object" and "postcheck_vague_noun_soft:bimanual" in flags
    assert C.postchecked({"left": "lift the object", "right": "n/a", "bimanual": "n/a"})[1]["left"] == "postcheck_vague_noun"


def test_json_answers():
    assert C.last_object('x {"left":"}"} {"a":1}', ("left", "right"), True) == '{"left":"}"}'
    assert C.last_object('{"a":1} {"b":{"c":2}}', ("z",)) == '{"b":{"c":2}}' and C.last_object("none", ("z",)) is None
    assert C.narration('{"left":"open jar","right":null}')[0]["left"] == "open jar"
    assert C.narration("{bad}")[1] == "json_decode" and C.narration("")[1] == "no_json" and C.narration('{"left":"n/a"}')[1] == "all_na"
    assert C.flags('```json\n{"global_na":"True"}\n```', ("left",), "_na")[0] == {"global_na": True, "left_na": True}
    assert C.flags('{"left_drop":true,"reason":"x"}', ("left", "right"), "_drop") == ({}, "parse_error")
    assert C.restored('abc","left":"x"}') == '{"think":"abc","left":"x"}'
