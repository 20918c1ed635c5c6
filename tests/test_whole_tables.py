"""Queries over whole tables against brute force."""

import json

import pytest

from wattspark import analog, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: getattr(analog, name)(spark, SF).collect() for name in ("workouts", "shares", "group_members", "activities")}


def found(spark, name):
    return sorted(map(tuple, registry.queries()[name](spark, SF).collect()), key=str)


def test_common_group_pairs_of_all_members(spark, tables):
    want = {(s.workout_id, m.user_id) for s in tables["shares"] for m in tables["group_members"] if s.group_id == m.group_id}
    assert {user % 50 for _, user in want} - {0}
    assert found(spark, "joi07_common_group") == sorted(want, key=str)


def test_left_chain_of_all_workouts(spark, tables):
    groups = {s.workout_id: s.group_id for s in tables["shares"]}
    loads = {a.id: a.estimated_tss for a in tables["activities"]}
    want = [(w.id, groups.get(w.id), loads.get(w.id)) for w in tables["workouts"]]
    assert found(spark, "joi26_left_chain") == sorted(want, key=str)


def test_owner_groups_of_all_workouts(spark, tables):
    groups = {s.workout_id: [s.group_id] for s in tables["shares"]}
    want = [(w.id, json.dumps(groups.get(w.id, [])) if w.uid == 7 else None) for w in tables["workouts"]]
    assert found(spark, "agg23_owner_groups") == sorted(want, key=str)
