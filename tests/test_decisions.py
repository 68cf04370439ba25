"""Hand-computed traces of baselines, trust and cooldown."""

import pytest

from sentrylake.operators.decisions import ActorState, Config


def test_baseline():
    s = ActorState(Config())
    assert s.baseline({"x": 1.0}) / 0.9 == pytest.approx(0.999999)
    assert s.baseline({"x": 1.0}) / 0.9 == pytest.approx(0.925704, abs=1e-6)


def test_trust():
    s = ActorState(Config())
    assert s.threshold() == pytest.approx(4.24)
    s.verdict(True)
    assert s.threshold() == pytest.approx(4.06)
    s = ActorState(Config())
    s.verdict(False)
    assert s.threshold() == pytest.approx(4.288)


def test_cooldown():
    s = ActorState(Config())
    assert [x for x in (10, 12, 15, 16, 21, 22) if s.fires("early", x)] == [10, 16, 22]
    assert s.fires("confirmed", 11)
