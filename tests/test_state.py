"""Value, map and queue state, against what each operation intends and against models."""

from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.streaming.state import DequeAccessor, LocalHandle, MapAccessor, ValueAccessor


@pytest.fixture
def queue():
    return DequeAccessor(LocalHandle(), "q")


@pytest.fixture
def mapping():
    return MapAccessor(LocalHandle(), "m")


def test_value_default_update_clear():
    v = ValueAccessor(LocalHandle(), "v", default="d")
    assert v.value() == "d"
    v.update("x")
    assert v.value() == "x"
    v.clear()
    assert v.value() == "d"


def test_queue_both_ends(queue):
    queue.add_first("b")
    queue.add_first("a")
    queue.add_last("c")
    assert (queue.value(), queue.size()) == (["a", "b", "c"], 3)
    assert (queue.peek_first(), queue.peek_last()) == ("a", "c")
    assert (queue.remove_first(), queue.remove_last(), queue.value()) == ("a", "c", ["b"])


def test_queue_empty(queue):
    assert queue.is_empty() and queue.peek_first() is None and queue.peek_last() is None
    for take in (queue.remove_first, queue.remove_last):
        with pytest.raises(IndexError):
            take()


def test_queue_clear_after_removals_and_update(queue):
    queue.update(["a", "b", "c", "d"])
    assert queue.value() == ["a", "b", "c", "d"]
    queue.remove_first()
    queue.clear()
    assert queue.is_empty() and not queue.items.held


def test_keys_are_apart():
    one, two = DequeAccessor(LocalHandle(), "q"), DequeAccessor(LocalHandle(), "q")
    one.add_last("a")
    assert two.is_empty()


def test_map_operations(mapping):
    assert mapping.is_empty() and mapping.get("k") is None
    mapping.put("k", "v")
    mapping.put("k", "w")
    mapping.put("l", "x")
    assert (mapping.get("k"), mapping.size(), sorted(mapping.keys()), dict(mapping.items())) == ("w", 2, ["k", "l"], {"k": "w", "l": "x"})
    mapping.remove("absent")
    assert mapping.size() == 2 and mapping.contains("l")
    mapping.remove("l")
    assert not mapping.contains("l")
    mapping.clear()
    assert mapping.size() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["add_first", "add_last", "remove_first", "remove_last", "clear"]), st.integers())))
def test_queue_follows_model(steps):
    real, model = DequeAccessor(LocalHandle(), "q", "bigint"), deque()
    for step, x in steps:
        if step.startswith("add"):
            getattr(real, step)(x)
            (model.appendleft if step == "add_first" else model.append)(x)
        elif step == "clear":
            real.clear()
            model.clear()
        elif model:
            assert getattr(real, step)() == (model.popleft if step == "remove_first" else model.pop)()
        assert real.value() == list(model)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["put", "remove", "clear"]), st.sampled_from("abc"), st.integers())))
def test_map_follows_model(steps):
    real, model = MapAccessor(LocalHandle(), "m", "bigint"), {}
    for step, k, x in steps:
        if step == "put":
            real.put(k, x)
            model[k] = x
        elif step == "remove":
            real.remove(k)
            model.pop(k, None)
        else:
            real.clear()
            model.clear()
        assert dict(real.items()) == model and real.size() == len(model)
