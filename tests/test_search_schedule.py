"""The searches' schedules, and what the registered searches ask for."""

import inspect
import math

import pytest

from lexmatch.operators import layout
from lexmatch.plans import registry

SEARCHES = ["anneal_layout", "anneal_topological_cache", "cache_aware_pipeline", "ordering_pipeline"]


class Held(Exception):
    pass


def test_defaults_are_the_references():
    """Start, rate and end of each search."""
    assert layout.schedule("cache") == layout.schedule("topological_cache") == (0.005, 0.999999995, 1e-9)
    assert layout.schedule("topological") == (50, 0.9999995, 1e-7) and layout.schedule("ordering") == (5e5, 0.999999, 1e-5)
    own = inspect.signature(layout.annealed).parameters
    assert all(own[x].default is None for x in ("moves", "start", "rate", "stop"))


@pytest.mark.parametrize("kind", layout.KINDS)
def test_moves_shorten_the_way_between_the_same_temperatures(kind):
    start, rate, stop = layout.schedule(kind, 1000)
    assert (start, stop) == layout.SCHEDULES[kind][::2] and math.isclose(start * rate**1000, stop, rel_tol=1e-9)


@pytest.mark.parametrize("name", SEARCHES)
def test_queries_search_by_a_stated_number_of_moves(monkeypatch, name):
    """Stops at the query's first search."""
    own = inspect.signature(layout.annealed)

    def annealed(*args, **named):
        bound = own.bind(*args, **named)
        bound.apply_defaults()
        raise Held([bound.arguments[x] for x in ("moves", "start", "rate", "stop")])

    class Rows:
        edges = None

        def nodes(self):
            return None

    monkeypatch.setattr(registry, "_rows", lambda *_: Rows())
    monkeypatch.setattr(registry, "written", lambda df, label: df)
    monkeypatch.setattr(layout, "annealed", annealed)
    with pytest.raises(Held) as found:
        registry.QUERIES[name](None, "")
    assert found.value.args[0] == [registry.MOVES, None, None, None]
